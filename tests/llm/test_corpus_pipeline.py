"""The pipeline, each stage against a brute-force version on the stage's own input."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
import test_decontaminate
import test_line_dedup
import test_simhash

from shopledger.llm import quality
from shopledger.llm.common import shared_folder, stored, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "the", "or", "is", "ti", "é"]) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    shared = line(12)
    rows = []
    for k in range(150):
        text = "\n".join(line(rng.randint(3, 30)) for _ in range(rng.randint(1, 6)))
        if k % 7 == 0:
            text = text.upper().replace(" ", "!! ")
        if k % 5 == 0:
            text += "\n" + shared[:20] + rng.choice(["", "x", "yz"]) + shared[20:]
        rows.append((k, text))
    for k in range(150, 170):
        rows.append((k, rows[k - 100][1]))
    for k in range(170, 180):
        changed = rows[k - 60][1].split(" ")
        changed[0] = "Other"
        rows.append((k, " ".join(changed)))
    items = [(k, line(14)) for k in range(5)]
    for k in range(180, 190):
        rows.append((k, line(20) + "\n" + items[k % 5][1].replace(" ", "  ") + "\n" + line(9)))
    rows += [(200, None), (201, ""), (202, "x"), (7, rows[8][1]), (8, rows[8][1]), (None, line(11)),
             (203, "word " * 20_000)]
    docs = [(i, t, None if k % 9 == 0 else "en", "hot" if k % 3 else None, k) for k, (i, t) in enumerate(rows)]
    labels = [(k, int(k % 7 != 0), 0) for k in range(120)]
    return docs, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs, labels, items = documents()
    spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as key").repartition(3).write.parquet(
        f"{folder}/documents.parquet"
    )
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    return str(folder)


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The documents before each stage, and after the last."""
    docs = [table(spark, folder, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], folder), "step"))
    return docs


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_columns(steps):
    for step in steps[1:-1]:
        assert step.columns == corpus_pipeline.COLUMNS


def test_quality_stage(spark, folder, steps):
    scores = quality.quality_scores(steps[0], table(spark, folder, "labels")).collect()
    good = [r.doc_id for r in scores if r.predicted]
    assert sorted(map(repr, good)) == sorted(repr(r.doc_id) for r in steps[1].collect())
    rejected = {r.doc_id for r in scores if not r.predicted}
    # 120 labels are few; id 7 has two texts.
    assert len({k for k in range(0, 120, 7)} - rejected) <= 4
    assert len(rejected & {k for k in range(120) if k % 7}) <= 2


def test_line_stage(steps):
    before = [(r.doc_id, r.text or "") for r in steps[1].collect()]
    # Ids that occur once, so that a plain dictionary holds them.
    ids = [i for i, _ in before]
    assert len({(i, t) for i, t in before}) >= len(set(ids))
    numbered = {}
    for i, t in sorted(set(before), key=lambda x: (x[0] is not None, x[0] or 0)):
        numbered.setdefault(i, []).append(t)
    plain = [((-1 if i is None else i) * 4 + k, t) for i, ts in numbered.items() for k, t in enumerate(ts)]
    want = test_line_dedup.expected(plain, 2, 24)
    found = {(r.doc_id, r.text) for r in steps[2].collect()}
    once = {i for i in numbered if len(numbered[i]) == 1}
    assert {x for x in found if x[0] in once} == {
        (i, want[(-1 if i is None else i) * 4][0]) for i in once
    }
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())
    assert steps[2].count() == steps[1].count()


def test_near_duplicate_stage(steps):
    before = [(r.doc_id, r.text) for r in steps[2].collect()]
    prints = [(k, test_simhash.plain_fingerprint(t or "")) for k, (_, t) in enumerate(before)]
    groups = {}
    for k, root in enumerate(test_simhash.components(prints, 3)):
        groups.setdefault(root, []).append(before[k][0])
    want = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
    assert sorted(map(repr, want)) == sorted(repr(r.doc_id) for r in steps[3].collect())


def test_benchmark_stage(spark, folder, steps):
    items = [tuple(r) for r in table(spark, folder, "benchmark").collect()]
    want = [
        (r.doc_id, r.text)
        for r in steps[3].collect()
        if not test_decontaminate.expected(r.text, items, 10)[1]
    ]
    assert sorted(want, key=repr) == rows_of(steps[4], "doc_id", "text")
    assert steps[3].count() - len(want) >= 5


def test_encoding_stage(steps):
    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model")
    )
    want = [(r.doc_id, library.encode(r.text or "")) for r in steps[4].collect()]
    assert sorted(want, key=repr) == rows_of(steps[5], "doc_id", "ids")


def test_run(spark, folder, steps):
    columns = ["doc_id", "n_tokens", "decoded_sha256"]
    assert rows_of(corpus_pipeline.run(spark, folder), *columns) == rows_of(steps[5], *columns)
    assert shared_folder(spark)


def test_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
