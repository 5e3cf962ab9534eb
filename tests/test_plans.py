"""What the plans of hot paths must look like."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tidemark.operators import filters, semantic
from tidemark.plans import catalogue, data_queries


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(filters.Scope(project="halcyon", kinds=["turn"], client="codex").where(spark.read.parquet(f"{sf}/docs.parquet")).select("id"))
    assert "EqualTo(project,halcyon)" in p and "EqualTo(kind,turn)" in p and "EqualTo(source_client,codex)" in p
    assert "files_json" not in p.split("ReadSchema")[1].split("\n")[0]


def test_top_k_moves_k_rows(spark, sf):
    p = plan(semantic.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), [1.0] * 64, 10, "embedding", "vec_id"))
    assert "TakeOrderedAndProject" in p and "Exchange hashpartitioning" not in p


def test_search_shuffles_no_documents(spark, sf):
    p = plan(catalogue.queries()["fts_weighted_bm25"](spark, sf))
    assert "hashpartitioning" not in p  # statistics are one row, scores are made where the rows lie


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_no_products(name, spark, sf):
    """The only products are with one row."""
    p = plan(catalogue.queries()[name](spark, sf))
    assert "CartesianProduct" not in p


def test_aggregates_are_partial_before_the_shuffle(spark, sf):
    p = plan(catalogue.queries()["session_inventory"](spark, sf))
    assert p.count("HashAggregate") >= 2


def test_zoned_texts_meet_no_table(spark, sf):
    from tidemark.operators import timestamps

    df = spark.read.parquet(f"{sf}/docs.parquet").select("id", "ts", "path", "src_offset")
    own = timestamps.parse(df.filter(F.col("ts").rlike(timestamps.CANONICAL)), "ts")
    assert "Join" not in plan(own) and "Python" not in plan(data_queries.queries()["p7_found"](spark, sf))
