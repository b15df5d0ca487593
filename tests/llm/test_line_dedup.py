"""Line dedup against brute force over all pairs of lines."""

import random

import corpus_pipeline
import pytest

from shopledger.llm import line_dedup, queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, line, edits, letters):
    line = list(line)
    for _ in range(edits):
        at = rng.randrange(len(line) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            line.insert(at, rng.choice(letters))
        elif at < len(line):
            line[at : at + 1] = [rng.choice(letters)] if kind == 1 else []
    return "".join(line)


def corpus(seed, n_docs=25, letters="abcé "):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(8, 30))) for _ in range(12)]
    docs = []
    for doc_id in range(n_docs):
        lines = []
        for _ in range(rng.randint(0, 7)):
            kind = rng.random()
            line = rng.choice(pool)
            lines.append(
                line
                if kind < 0.3
                else edited(rng, line, rng.randint(1, 4), letters)
                if kind < 0.8
                else ""
                if kind < 0.9
                else "x" * rng.randint(1, 12)
            )
        docs.append((doc_id * 7 % n_docs, "\n".join(lines)))
    return docs


def expected(docs, threshold, min_chars):
    occurrences = sorted(
        (doc_id, number, line)
        for doc_id, text in docs
        for number, line in enumerate(text.split("\n"))
        if line.strip()
    )
    lines = {line for _, _, line in occurrences}
    links = {
        line: {
            other
            for other in lines
            if other != line
            and min(len(line), len(other)) >= min_chars
            and abs(len(line) - len(other)) <= threshold
            and distance(line, other) <= threshold
        }
        for line in lines
    }
    first = {}
    for doc_id, number, line in occurrences:
        first.setdefault(line, (doc_id, number))
    result = {doc_id: [text.split("\n"), [], 0, set()] for doc_id, text in docs}
    for doc_id, number, line in occurrences:
        earliest = min([first[line], *(first[x] for x in links[line])])
        result[doc_id][2] += len(links[line])
        if earliest < (doc_id, number):
            result[doc_id][1].append(number)
            result[doc_id][3].add(earliest[0])
    return {
        doc_id: (
            "\n".join(x for k, x in enumerate(lines) if k not in gone),
            len(gone),
            n_links,
            sorted(sources),
        )
        for doc_id, (lines, gone, n_links, sources) in result.items()
    }


def found(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = line_dedup.deduplicated(df, **options).collect()
    return {r.doc_id: (r.text, r.n_removed, r.n_links, r.sources) for r in rows}


@pytest.mark.parametrize(
    "threshold, run_pairs, block",
    [(1, 4096, 1024), (2, 4096, 1024), (2, 1, 1024), (2, 0, 2), (3, 0, 2)],
)
def test_same_as_all_pairs(spark, threshold, run_pairs, block):
    docs = corpus(threshold)
    options = {"threshold": threshold, "min_chars": 2 * threshold + 2}
    sizes = {"run_pairs": run_pairs, "block": block}
    assert found(spark, docs, **sizes, **options) == expected(docs, **options)


def test_verification_is_the_edit_distance():
    rng = random.Random(3)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("ab€") for _ in range(rng.randint(0, 14)))
        pairs.append((a, edited(rng, a, rng.randint(0, 5), "ab€")))
    for threshold in (0, 1, 2, 3):
        near = line_dedup._within_many(pairs, threshold)
        assert near.tolist() == [distance(a, b) <= threshold for a, b in pairs]


def test_probes_reach_every_shared_segment():
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(6, 20)))
        b = edited(rng, a, 2, "abc")
        a, b = sorted((a, b), key=len)
        if len(a) < 6 or distance(a, b) > 2:
            continue
        own = {(seed, a[s:e]) for seed, s, e in line_dedup.indexed(len(a), 2)}
        asked = {(seed, b[s:e]) for seed, s, e in line_dedup.probes(len(b), 2)}
        assert own & asked


def test_edge_rows(spark):
    long = "one two three four five six seven eight nine ten " * 3000
    docs = [
        (1, None), (2, ""), (3, "\n\n"), (4, long), (5, long + "x"), (5, "other words of five"),
        (None, "a line without any id here"), (6, "a line without any id here"),
        (7, "same row"), (7, "same row"), (8, "same row\r\nrest"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "1 as n_lines", "2 as line", "3 as key"
    )
    rows = sorted(
        ((r.doc_id, r.text, r.n_removed) for r in line_dedup.deduplicated(df).collect()),
        key=lambda r: (-1 if r[0] is None else r[0], r[1]),
    )
    assert rows == [
        (None, "a line without any id here", 0),
        (1, "", 0),
        (2, "", 0),
        (3, "\n\n", 0),
        (4, long, 0),
        (5, "", 1),
        (5, "other words of five", 0),
        (6, "", 1),
        (7, "same row", 0),
        (7, "same row", 0),
        (8, "rest", 1),
    ]
    assert line_dedup.deduplicated(df.limit(0)).collect() == []


def expected_kept(docs, linked):
    """Kept texts and sources if a line goes only behind an equal or linked one that stays."""
    kept, texts = [], {}
    for doc_id, text in sorted(docs):
        lines, sources = [], set()
        for line in text.split("\n"):
            near = [i for i, other in kept if other == line or linked(line, other)]
            if near and line.strip():
                sources.add(near[0])
                continue
            lines.append(line)
            if line.strip():
                kept.append((doc_id, line))
        texts[doc_id] = ("\n".join(lines), sorted(sources))
    return texts


@pytest.mark.parametrize("at_once", [line_dedup.AT_ONCE, 0])
def test_chains_keep_what_no_kept_line_stands_for(spark, at_once):
    chain = ["the first line of the chain" + "x" * 2 * k for k in range(7)]
    counters = [f"Record number 00{k // 10}{k % 10}0 of the list." for k in range(40)]
    docs = [(1, "\n".join(chain[:3])), (2, "\n".join(chain[3:])), (3, "\n".join(counters))]
    docs += [(i + 4, text) for i, text in corpus(2)]
    rows = found(spark, docs, threshold=2, min_chars=6, chains=True, at_once=at_once)

    def linked(a, b):
        return min(len(a), len(b)) >= 6 and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2

    want = expected_kept(docs, linked)
    assert {i: (text, sources) for i, (text, _, _, sources) in rows.items()} == want
    assert (rows[1][0], rows[2][0]) == (f"{chain[0]}\n{chain[2]}", f"{chain[4]}\n{chain[6]}")


def test_query_and_pipeline_keep_chains(spark, tmp_path):
    chain = ["the first line of the chain" + "x" * 2 * k for k in range(3)]
    rows = [(k, line, "en", "src", 1) for k, line in enumerate(chain)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    removed = {r.doc_id: r.n_removed for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert removed == {0: 0, 1: 1, 2: 0}
    left = corpus_pipeline.without_repeated_lines(spark, df, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in left} == {0: chain[0], 1: "", 2: chain[2]}


@pytest.mark.parametrize("run_pairs, block", [(4096, 1024), (1, 1024), (0, 2)])
def test_short_lines_with_fewer_edits(spark, run_pairs, block):
    docs = corpus(4, letters="abé ")
    docs += [(50, "Are is anwh reenen."), (51, "Are, is anwh reenen."), (52, "The eran."),
             (53, "The, eran."), (54, "a" * 11), (55, "a" * 12), (56, "a" * 13)]

    def linked(a, b):
        edits = min(2, min(len(a), len(b)) // 12)
        return abs(len(a) - len(b)) <= edits and distance(a, b) <= edits

    sizes = {"run_pairs": run_pairs, "block": block}
    rows = found(spark, docs, threshold=2, min_chars=24, scaled=True, chains=True, **sizes)
    assert {i: (text, sources) for i, (text, _, _, sources) in rows.items()} == expected_kept(docs, linked)
    assert [rows[k][1] for k in range(50, 57)] == [0, 1, 0, 0, 0, 0, 1]


def test_query_compares_short_lines(spark, tmp_path):
    rows = [(1, "The anhely eran."), (2, "The, anhely eran.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    removed = {r.doc_id: r.n_removed for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert removed == {1: 0, 2: 1}
