"""Suffix orders and common prefixes against sorted lists."""

import os
import random

import numpy as np
import pytest

from shopledger.llm import induced


def strings(seed):
    rng = random.Random(seed)
    letters = rng.choice([[1], [1, 2], [1, 2, 3], list(range(1, 40))])
    pool = [[rng.choice(letters) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 8))]
    out = []
    for _ in range(rng.randint(1, 40)):
        out.append([x for _ in range(rng.randint(1, 3)) for x in rng.choice(pool)])
    return out


def text_of(rows):
    return np.array([x for row in rows for x in [*row, 0]], np.int64)


def shard_of(folder, parts, n_symbols):
    shard = induced.Shard(str(folder), n_symbols)
    for part in parts:
        shard.add(part)
    return shard.closed()


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("held, chunk", [(1 << 20, 1 << 16), (7, 5), (40, 16)])
@pytest.mark.parametrize("seed", range(12))
def test_order_and_common_prefixes(tmp_path, monkeypatch, seed, held, chunk):
    monkeypatch.setattr(induced, "CHUNK", chunk)
    rows = strings(seed)
    text = text_of(rows)
    shard = shard_of(tmp_path, np.array_split(text, 4), 41)
    longest = 12
    found = list(induced.ordered(shard, longest, held))
    at = np.concatenate([a for a, _ in found]).tolist()
    common = np.concatenate([c for _, c in found]).tolist()
    assert sorted(at) == list(range(len(text) - 1))  # nothing stands behind the last end
    ends = np.flatnonzero(text == 0).tolist()
    suffix = {p: tuple(text[p : next(e for e in ends if e >= p)].tolist()) for p in range(len(text))}
    inside = [(p, c) for p, c in zip(at, common) if suffix[p]]
    assert [suffix[p] for p, _ in inside] == sorted((s for s in suffix.values() if s), reverse=True)
    for (p, _), (q, c) in zip(inside, inside[1:]):
        assert c == min(longest, shared(suffix[p], suffix[q]))


@pytest.mark.parametrize("held", [1 << 20, 9])
def test_repeated_places(tmp_path, held):
    rng = random.Random(held)
    rows = [[rng.randint(1, 3) for _ in range(30)] for _ in range(30)]
    rows += [rows[0], rows[1][3:], [5] * 40, [5] * 9]
    text = text_of(rows)
    shard = shard_of(tmp_path, [text], 6)
    hits = induced.repeated_places(shard, 8, held)
    windows = [tuple(text[k : k + 8].tolist()) for k in range(len(text))]
    whole = [len(w) == 8 and 0 not in w for w in windows]
    counts = {}
    for w, ok in zip(windows, whole):
        counts[w] = counts.get(w, 0) + ok
    assert hits.tolist() == [ok and counts[w] > 1 for w, ok in zip(windows, whole)]


def test_queues_are_on_disk(tmp_path):
    """Far more rows than are held: files grow, and nested folders hold the recursion."""
    rng = random.Random(1)
    pool = [[rng.randint(1, 20) for _ in range(30)] for _ in range(60)]
    text = text_of([rng.choice(pool) + rng.choice(pool) for _ in range(1500)])
    whole, small = tmp_path / "whole", tmp_path / "small"
    whole.mkdir(), small.mkdir()
    want = induced.repeated_places(shard_of(whole, [text], 21), 25, 1 << 20)
    found = induced.repeated_places(shard_of(small, np.array_split(text, 9), 21), 25, 1000)
    assert want.any() and (found == want).all()
    assert all(os.path.getsize(small / name) > 100_000 for name in ("large", "kept", "small"))
    assert os.path.exists(small / "names" / "names") and not os.path.exists(whole / "names")


def test_names_by_recursion_are_names_by_doubling(tmp_path):
    rng = random.Random(5)
    for k, limit in enumerate([2, 5, 400]):
        names = np.array([rng.randint(1, limit) for _ in range(800)] + [0])
        folder = tmp_path / str(k)
        folder.mkdir()
        assert induced.order_of_names(str(folder), names, 25).tolist() == induced.doubled(names).tolist()


def test_empty_shard(tmp_path):
    shard = shard_of(tmp_path, [], 3)
    assert list(induced.ordered(shard, 5, 10)) == [] and not len(induced.repeated_places(shard, 5, 10))
