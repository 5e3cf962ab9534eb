"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import datetime
import math
import os
import pathlib
from collections import Counter

import duckdb
import pytest

from tidemark.plans import catalogue, data_queries

DIR = "/root/testdata/sf0.001"
Q = {**catalogue.queries(), **data_queries.queries()}
SQL = {**catalogue.oracle_sql(), **data_queries.oracle_sql()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(DIR):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, duck):
    df = Q[name](spark, DIR)
    cols = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert mine == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_queries_without_sql_run(spark):
    for name in sorted(set(Q) - set(SQL)):
        assert Q[name](spark, DIR).count() >= 0, name


def test_nothing_outside_imports_llm():
    root = pathlib.Path(__file__).resolve().parents[1] / "tidemark"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tidemark.llm" not in p.read_text(), p
