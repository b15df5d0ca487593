"""Registered queries against their SQL on the given tables, and what may be imported."""

import ast
import pathlib
import sys

import duckdb
import pytest

import shopledger
from shopledger.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(shopledger.__file__).parent


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    rows = sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM want").fetchall()))
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == columns
    assert sorted(repr(tuple(r)) for r in found.select(*columns).collect()) == rows


# Queries of one row per document that SQL cannot express.
PER_DOCUMENT = [f"op{n}_" for n in (3, 4, 5, 6, 7, 9, 10)]


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q.startswith(tuple(PER_DOCUMENT))))
def test_one_row_per_document(spark, name):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    found = QUERIES[name](spark, SF)
    ids = sorted(r.doc_id for r in found.select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in documents.select("doc_id").collect())


def test_nothing_else_imports_this_part():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                names += [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in name.split(".") for name in names), path


def test_no_local_checkpoints():
    for path in (ROOT / "llm").glob("*.py"):
        assert "localCheckpoint" not in path.read_text()


def test_registered():
    sys.path.insert(0, str(ROOT.parent))
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {name.split("_")[0] for name in names}
    assert "pipeline" in names
