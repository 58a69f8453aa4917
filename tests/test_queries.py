"""Registered queries against their SQL, on the smallest tables (the driver checks all at sf0.01)."""

import importlib.util
import os

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SAMPLE = (
    "cadence_buckets",
    "merge_short",
    "flag_anomalies",
    "segment_uncertainty",
    "dedupe_overlaps",
    "segment_files",
    "report_files",
    "silence_splits_short",
    "vad_chunks_sliced",
    "apply_reprocessed",
    "bucket_markdown",
    "processing_performance",
)


@pytest.fixture(scope="module")
def contract():
    spec = importlib.util.spec_from_file_location("contract", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def test_every_oracle_belongs_to_a_query(contract):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 100


def _plain(v):
    if v is None:
        return "~"
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, small, contract, duck, name):
    df = contract.queries()[name](spark, small)
    cursor = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    order = sorted(columns)
    assert sorted(df.columns) == order
    want = sorted(tuple(_plain(row[columns.index(c)]) for c in order) for row in cursor.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in order) for r in df.collect()) == want


def test_entry_runs(spark, contract):
    assert contract.entry(spark).count() > 0
