"""The entry points, and every query with SQL against DuckDB on the smallest tables."""

import glob
import importlib
import os
import sys

import duckdb
import pytest

D = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


def flat(x):
    if isinstance(x, (list, tuple)):
        return tuple(flat(y) for y in x)
    return round(x, 6) if isinstance(x, float) else x


def test_core_stands_alone(monkeypatch):
    monkeypatch.setitem(sys.modules, "thornbill.llm", None)
    monkeypatch.setitem(sys.modules, "thornbill.llm.queries", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "bm25_topk" in entry.queries() and not any(k.startswith("p1_") for k in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:4] == ["qid", "rank", "chunk_id", "passage_id"]


from thornbill.plans.catalogue import ORACLES, QUERIES  # noqa: E402


@needs_data
@pytest.mark.parametrize("name", [k for k in ORACLES if k not in ("ablation_arms", "calibration_sweep", "calibration_quantiles", "gold_hits")])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    ours = QUERIES[name](spark, D)
    theirs = con.sql(ORACLES[name])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    a = sorted((tuple(flat(r[c]) for c in names) for r in ours.collect()), key=repr)
    at = [theirs.columns.index(c) for c in names]
    b = sorted((tuple(flat(r[i]) for i in at) for r in theirs.fetchall()), key=repr)
    assert a == b
