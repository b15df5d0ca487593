"""Benchmark windows against a plain search."""

import random
import re

import numpy as np
import pytest

from shopledger.llm import automaton, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def expected(text, items, window):
    mine, hit, names = words(text), set(), set()
    for item, item_text in items:
        theirs = words(item_text)
        n = min(window, len(theirs))
        wins = {tuple(theirs[k : k + n]) for k in range(len(theirs) - n + 1)} if n else set()
        for at in range(len(mine) - n + 1 if n else 0):
            if tuple(mine[at : at + n]) in wins:
                hit.update(range(at, at + n))
                names.add(str(item))
    return len(mine), len(hit), sorted(names)


def case(seed):
    rng = random.Random(seed)
    pool = ["Alpha", "beta", "BETA", "γάμμα", "Élan", "x1", "2", "the", "of"]
    say = lambda n: "".join(
        rng.choice(pool) + rng.choice([" ", ", ", "-", "\n", "_"]) for _ in range(n)
    )
    items = [(k, say(rng.randint(0, 9))) for k in range(14)] + [(3, say(5)), (20, None), (21, "?!")]
    docs = []
    for k in range(60):
        parts = [say(rng.randint(0, 12))]
        if rng.random() < 0.6:
            parts += [(rng.choice(items)[1] or "").upper(), say(4)]
        docs.append((k, " ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "..."), (5, docs[5][1]), (None, items[0][1])], items


def test_same_as_plain_search(spark):
    docs, items = case(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as hits")
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as item")
    rows = decontaminate.contamination(df, benchmark, window=4).collect()
    found = sorted(str((r.doc_id, r.n_words, r.n_hit, r.item_ids)) for r in rows)
    want = {(i, t): expected(t, items, 4) for i, t in docs}
    assert found == sorted(str((i, *want[i, t])) for i, t in docs)
    clean = decontaminate.clean(df, benchmark, window=4)
    assert clean.columns == df.columns
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(
        str((i, t)) for i, t in docs if not want[i, t][1]
    )


def test_spans_are_places_in_the_original(spark):
    text = "Née: THE Quick—brown fox; jumps. Over"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, "the quick—brown fox jumps")], "item_id long, text string")
    row = decontaminate.contamination(df, benchmark, window=3).first()
    assert [text[s.start : s.end] for s in row.spans] == ["THE Quick—brown fox; jumps"]


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.contamination(df, nothing).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in rows) == [
        (1, 2, 0, []),
        (2, 0, 0, []),
    ]
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontaminate.contamination(df.limit(0), items).collect() == []


def test_a_very_long_text(spark):
    text = "lorem ipsum " * 50_000 + "needle in a hay stack"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "needle in a hay stack")], "item_id long, text string")
    row = decontaminate.contamination(df, items).first()
    assert (row.n_words, row.n_hit) == (100_005, 5)


def test_items_without_id_are_searched(spark):
    docs = [(1, "so one two three four."), (2, "five six seven eight"), (3, "one two THREE five six seven"),
            (4, "nine ten eleven"), (5, "other words")]
    items = [(None, "one two three"), (7, "five six seven"), (None, "nine ten eleven"), (8, "one two three")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(df, benchmark, window=3).collect()
    assert sorted((r.doc_id, r.n_hit, r.item_ids) for r in rows) == [
        (1, 3, [None, "8"]), (2, 3, ["7"]), (3, 6, [None, "7", "8"]), (4, 3, [None]), (5, 0, []),
    ]
    left = decontaminate.clean(df, benchmark, window=3).collect()
    assert [r.doc_id for r in left] == [5]


def test_lanes_are_one_scan(tmp_path, monkeypatch):
    docs, items = case(7)
    texts = [(t or "").encode() for _, t in items]
    held = automaton.build(texts, [str(i) for i, _ in items], 3)
    held.save(tmp_path / "one")
    mapped = automaton.Automaton.load(tmp_path / "one")
    words = automaton.words_in([(t or "").encode() for _, t in docs] * 5)
    found = []
    for lanes, made in ((1, held), (7, mapped), (4096, mapped)):
        monkeypatch.setattr(automaton, "LANES", lanes)
        found.append(sorted(zip(*[x.tolist() for x in made.matches(words)])))
    assert found[0] and found[0] == found[1] == found[2]


@pytest.mark.parametrize("window", [1, 2, 6])
def test_states_are_the_longest_suffixes(window):
    rng = random.Random(window)
    texts = [" ".join(rng.choices("abc", k=rng.randint(1, 9))).encode() for _ in range(12)]
    held = automaton.build(texts, [None] * 12, window)
    spelled = np.concatenate([[0], held.spelled_ends])
    letters = [held.spelled[a:b].tobytes().decode() for a, b in zip(spelled, spelled[1:])]
    prefixes = {()}
    for text in texts:
        words = text.decode().split()
        for k in range(max(1, len(words) - window + 1)):
            prefixes |= {tuple(words[k : k + n]) for n in range(window + 1) if k + n <= len(words)}
    stream = [rng.randint(0, 3) for _ in range(300)]
    states = held.states(np.array(stream, np.int32))
    for k, depth in enumerate(held.depth(states).tolist()):
        said = [letters[s - 1] if s else "?" for s in stream[: k + 1]]
        want = next(n for n in range(window, -1, -1) if n <= k + 1 and tuple(said[k + 1 - n :]) in prefixes)
        assert depth == want


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(automaton, "word_hashes", lambda words, seed: np.array(
        [len(words.data[a:b]) for a, b in zip(words.starts, words.ends)], np.uint64))
    held = automaton.build([b"a bb ccc"], ["x"], 3)
    words = automaton.words_in([b"a bb ddd a bb ccc", b"z bb ccc"])
    ends, states = held.matches(words)
    assert ends.tolist() == [5] and held.name(held.owners_of(states)[0][0]) == "x"


def test_many_windows_in_one_stage(spark):
    """200,000 windows are one automaton, and one stage reads the documents."""
    rng = random.Random(3)
    pool = [f"w{k}" for k in range(5000)]
    texts = [rng.choices(pool, k=60) for _ in range(4000)]
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "item_id long, text string")
    docs = [(k, " ".join(texts[k][20:35] + rng.choices(pool, k=300))) for k in range(0, 4000, 8)]
    docs += [(10_000 + k, " ".join(rng.choices(pool, k=300))) for k in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.contamination(df, benchmark)
    rows = {r.doc_id: (r.n_hit, r.item_ids) for r in found.collect()}
    assert all(rows[k] == (15, [str(k)]) for k in range(0, 4000, 8))
    assert all(rows[10_000 + k] == (0, []) for k in range(500))
    plan = found._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1
