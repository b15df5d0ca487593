"""Merkle fingerprints: equality, locality of edits, and the order of documents."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from shopledger.llm import merkle


def prose(seed, lines=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(2, 9)))
    return "\n".join(
        " ".join(word() for _ in range(rng.randint(0, 25))) if rng.random() < 0.9 else ""
        for _ in range(lines)
    )


def test_equal_texts_only():
    texts = {prose(k, k) for k in range(30)} | {"", "\n", "\n\n", " ", "a", "a\n", "a\n\n", "a b"}
    prints = {t: merkle.fingerprint(t.encode()) for t in texts}
    assert len({p[: merkle.ROOT] for p in prints.values()}) == len(texts)
    assert all(merkle.likeness(p, p) == 1 for p in prints.values())


def test_leaves_cover_the_text():
    for k in range(30):
        text = prose(k).encode()
        _, sections = merkle.tree(text)
        leaves = [leaf for _, paragraphs in sections for _, ls in paragraphs for leaf in ls]
        assert b"".join(text[a:b] for _, a, b in leaves) == text


def test_edits_stay_local():
    for k in range(20):
        old = prose(k)
        at = len(old) // 3
        new = old[:at] + "XYZ" + old[at + 2 :]
        near = merkle.likeness(merkle.fingerprint(old.encode()), merkle.fingerprint(new.encode()))
        assert 0.9 < near < 1
        spans = merkle.changed_spans(old, new)
        assert any(a <= at and at + 3 <= b for a, b in spans)
        assert sum(b - a for a, b in spans) < len(new) / 4
    assert merkle.changed_spans("same", "same") == []


REPEATED = ["word " * 5000, "The cat sat. " * 1000, "中文字" * 2000, ", ".join(map(str, range(3000)))]
REPEATED += ["a" * 9000, "ab" * 4000, "\n" * 500, "é" * 3000, "no spaces" * 700, "line\n" * 900]


@pytest.mark.parametrize("text", [*REPEATED, prose(50, 60), prose(51, 60).replace("\n", " ")])
@pytest.mark.parametrize("share", [0.25, 0.5, 0.9])
def test_likeness_is_near_the_kept_share(text, share):
    kept, other = int(len(text) * share), prose(99, 4000).replace("\n", "\r")
    for new in (text[:kept] + other[: len(text) - kept], other[: len(text) - kept] + text[-kept:]):
        a, b = text.encode(), new.encode()
        size = len(text[:kept].encode()) if new.startswith(text[:kept]) else len(text[-kept:].encode())
        near = merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b))
        assert abs(near - 2 * size / (len(a) + len(b))) < 0.1


def test_leaves_are_bounded():
    for text in [*REPEATED, prose(3), "\x00" * 500, "x" * 64, "x" * 65, "😀" * 100, "é\n" * 40]:
        _, sections = merkle.tree(text.encode())
        leaves = [leaf for _, paragraphs in sections for _, ls in paragraphs for leaf in ls]
        assert all(0 < b - a <= merkle.LONGEST for _, a, b in leaves)
        for _, a, b in leaves:
            text.encode()[a:b].decode()  # whole characters


def test_alone_and_among_others():
    texts = [t.encode() for t in [prose(1), "", "x", *REPEATED, prose(2), "é" * 11, ""]]
    assert merkle.fingerprints_of(texts) == [merkle.fingerprint(t) for t in texts]


def test_likeness_is_symmetric_and_bounded():
    prints = [merkle.fingerprint(t.encode()) for t in ["", "x", prose(1), prose(2), prose(1) * 2]]
    for a in prints:
        for b in prints:
            assert 0 <= merkle.likeness(a, b) == merkle.likeness(b, a) <= 1


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_same_as_one_sorted_list(spark, parts):
    rng = random.Random(1)
    docs = [(rng.randint(-(10**12), 10**12), prose(k, rng.randint(0, 6))) for k in range(60)]
    docs += [(5, None), (6, ""), (7, "é"), (7, "é"), (8, "one"), (8, "other"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as part", "2 as tie")
    rows = merkle.edit_likeness(df.repartition(4), parts=parts).collect()
    assert len(rows) == len(docs)
    # Ties are ordered by a hash; ids that occur once, with neighbours that do, are told exactly.
    ids = [i for i, _ in docs]
    ordered = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    by_id = {r.doc_id: r for r in rows}
    for (i, text), (j, following) in zip(ordered, ordered[1:] + ordered[:1]):
        if ids.count(i) > 1 or ids.count(j) > 1:
            continue
        text, following, row = text or "", following or "", by_id[i]
        half = len(text) // 2
        edited = (text[: len(text) - half] + following[:half]).encode()
        own, other = merkle.fingerprint(text.encode()), merkle.fingerprint(edited)
        near = merkle.likeness(own, merkle.fingerprint(following.encode()))
        assert tuple(row) == (
            i, len(text), hashlib.sha256(edited).hexdigest(), own, other,
            merkle.likeness(own, other), near,
        )


@pytest.mark.parametrize("parts", [1, 6, 40])
def test_an_id_of_many_rows_is_cut(spark, parts):
    """A third of the rows has one id, a third none; ties are in the order of their hashes."""
    docs = [(7, f"seven {k} " * 5) for k in range(60)] + [(None, f"none {k} " * 5) for k in range(60)]
    docs += [(100 + k, f"other {k} " * 5) for k in range(30)] + [(-k, f"low {k} " * 5) for k in range(1, 31)]
    docs += [(7, "seven 3 " * 5)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = merkle.edit_likeness(df.repartition(4), parts=parts).collect()
    tie = {t: np.array(xxhash.xxh64_intdigest(t, 42), np.uint64).astype(np.int64).item() for _, t in docs}
    ordered = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), tie[d[1]]))
    want = []
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        edited = (text[: len(text) - half] + following[:half]).encode()
        want.append((str(i), merkle.fingerprint(text.encode()), hashlib.sha256(edited).hexdigest()))
    assert sorted((str(r.doc_id), r.fingerprint, r.edited_sha256) for r in rows) == sorted(want)
    cut = merkle.Parts([7] * 4 + [9])
    found = cut.of(pa.array([7] * 100), pa.array([(k << 57) - (1 << 63) for k in range(100)]))[1]
    assert found.tolist() == sorted(found.tolist()) and len(set(found.tolist())) == 4


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    row = merkle.edit_likeness(df).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1
    assert merkle.edit_likeness(df.limit(0)).collect() == []
    assert merkle.fingerprints(df).first().fingerprint == merkle.fingerprint(b"abcd")


def test_a_very_long_text():
    text = prose(3, 4000)
    near = merkle.likeness(
        merkle.fingerprint(text.encode()), merkle.fingerprint((text + "\nmore").encode())
    )
    assert near > 0.999
