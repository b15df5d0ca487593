"""From documents to token ids in five stages.

Each stage is a function of the session, the documents left so far and the folder of the
other tables. Its result is written as Parquet and read again as the next one's documents.

1. quality: documents scored under 0.5 go.
2. line dedup: lines equal to, or within two edits (one if shorter than 24 characters, none if
   shorter than 12) of, an earlier line that stays go; a document all
   of whose lines go stays as an empty text, which the next stage sees as copies.
3. SimHash near-dedup: of each group of near-duplicates the one of smallest id stays.
4. decontamination: documents with a benchmark window go.
5. encoding: token ids, with digests of what they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shopledger.llm import decontaminate, line_dedup, pieces, quality, simhash
from shopledger.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(
        docs, columns=("lang", "source"), threshold=2, min_chars=24, chains=True, scaled=True
    )
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs.select(*COLUMNS), shingle=3, max_distance=3)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), window=10)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding", encoded),
]

# A trained classifier cannot be expressed in SQL; tests compare stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
