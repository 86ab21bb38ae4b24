"""Registered queries against their SQL on the small tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
duckdb = pytest.importorskip("duckdb")


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, db, name):
    frame = entry.queries()[name](spark, DIR)
    columns = sorted(frame.columns)
    ours = sorted(tuple(value(r[c]) for c in columns) for r in frame.collect())
    relation = db.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert ours == sorted(tuple(value(r[k]) for k in at) for r in relation.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["passage_ids", "minhash_dedup", "chunk_stats", "parse_answers", "parse_graph_records", "greedy_title_pairing", "optimal_title_pairing", "field_token_counts", "composite_scores", "harness_scores", "harness_summary"])
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0
