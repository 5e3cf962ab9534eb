import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift, merkle

S = "rec_id int, path string, type string, payload string"


@pytest.fixture
def agreed(spark):
    return spark.createDataFrame([("a", "x", "string", True), ("a", "n", "number", True), ("a", "o", "object", False), ("b|m", "type", "string", True)], "kind string, field string, json_type string, required boolean")


def test_departures(spark, agreed):
    rows = [
        (1, "p", "a", '{"x": "1", "n": 2}'), (2, "p", "a", '{"x": 5, "n": null}'), (3, "p", "zz", "{}"), (4, "p", "a", '{"x": "1", "n'), (5, "p", "a", None), (6, "p", "a", "[1]"),
        (7, "q", "a", '{"y": "1", "n": 2, "extra": true}'), (8, "q", "a", '{"y": "2", "n": 2}'), (9, "r", "a", '{"x": "v", "o": {"k": 1}}'), (10, "r", "b", '{"type": "m", "new": []}'), (10, "r", "b", '{"type": "m", "new": []}'),
    ]
    got = {tuple(r) for r in drift.departures(spark.createDataFrame(rows, S), agreed).collect()}
    assert got == {
        ("p", "a", "x", "retyped"), ("p", "zz", "*", "kind_added"), ("q", "a", "x", "renamed"), ("q", "a", "extra", "added"), ("r", "a", "n", "removed"), ("r", "b|m", "new", "added"),
    }


def test_ingest_keeps_everything_and_replays(spark, agreed):
    rows = [(1, "p", "a", '{"x": "1", "n": 2, "more": {"q": [1, "é"]}}'), (2, "p", "a", '{"x": 7, "n": "no"}'), (3, "p", "a", "cut {"), (4, None, None, None)]
    t = drift.ingest(spark.createDataFrame(rows, S).withColumn("kind", F.lit("clash")), agreed)
    got = {r["rec_id"]: r.asDict() for r in t.collect()}
    assert (got[1]["f_x"], got[1]["f_n"], json.loads(got[1]["_rescued"])) == ("1", 2.0, {"more": {"q": [1, "é"]}})
    assert (got[2]["f_x"], json.loads(got[2]["_rescued"]), got[3]["_raw"], got[4]["_raw"]) == (None, {"x": 7, "n": "no"}, "cut {", None)
    again = {r["rec_id"]: r.asDict() for r in drift.replay(t, "a", "more", "f_more", "object").collect()}
    assert json.loads(again[1]["f_more"]) == {"q": [1, "é"]} and again[1]["_rescued"] is None and again[2]["_rescued"] == got[2]["_rescued"]


def test_empty_drift(spark, agreed):
    e = spark.createDataFrame([], S)
    assert drift.departures(e, agreed).count() == 0 and drift.ingest(e, agreed).count() == 0
    none = drift.departures(spark.createDataFrame([(1, "p", "a", "{}")], S), agreed.limit(0)).collect()
    assert [tuple(r) for r in none] == [("p", "a", "*", "kind_added")]


F_ = "path string, size bigint, sha string, listed_at timestamp"
C_ = "path string, sha string, offset bigint, ingested_at string, state string"


def test_pending_files(spark):
    now = "2026-11-02 06:00:00"
    files = [
        ("/a/same", 10, "s", now), ("/a/grown", 20, "s", now), ("/a/rewritten", 20, "other", now), ("/a/shrunk", 5, "s", now), ("/a/new", 7, "s", now), ("/a/empty", 0, "s", now), ("/b/moved", 30, "m", now),
        ("/a/failed", 10, "s", now), ("/a/twice", 10, "s", "2026-11-01 06:00:00"), ("/a/twice", 15, "s", now), ("C:\\x\\win", 9, "w", now), (None, 3, "s", now),
    ]
    marks = [
        ("/a/same", "s", 10, "1", None), ("/a/grown", "s", 10, "1", '{"run": "ok", "committed": 3}'), ("/a/rewritten", "s", 10, "1", None), ("/a/shrunk", "s", 10, "1", None), ("/a/empty", "s", 0, "1", None),
        ("/old/moved", "m", 12, "1", None), ("/a/failed", "s", 10, "1", '{"run": "failed", "committed": 4}'), ("/a/twice", "s", 12, "1", "{bad"), ("D:\\y\\win", "w", 4, "1", None), ("/gone", "s", 1, "1", None),
    ]
    df = spark.createDataFrame(files, "path string, size int, sha string, at string").select("path", F.col("size").cast("bigint"), "sha", F.col("at").cast("timestamp").alias("listed_at"))
    got = {(r[0], r[1]) for r in merkle.pending_files(df, spark.createDataFrame(marks, C_), 8).select("path", "from_offset").collect()}
    assert got == {("/a/grown", 10), ("/a/rewritten", 0), ("/a/shrunk", 0), ("/a/new", 0), ("/b/moved", 12), ("/a/failed", 4), ("/a/twice", 12), ("C:\\x\\win", 4), (None, 0)}
    assert merkle.pending_files(df.limit(0), spark.createDataFrame(marks, C_), 8).count() == 0
    assert merkle.pending_files(df, spark.createDataFrame([], C_), 8).count() == 10


def test_descends_only_where_digests_differ(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    key, vals = F.col("k"), [F.col("k"), F.col("v")]
    one = merkle.tree(rows, key, vals, 12)
    two = merkle.tree(rows.withColumn("v", F.when(F.col("k") == "77", 2).otherwise(1)), key, vals, 12)
    assert merkle.changed_leaves(one, one, 12).count() == 0
    assert merkle.changed_leaves(one, two, 12).count() == 1
    hot = merkle.extract(rows, key, merkle.changed_leaves(one, two, 12), 12).collect()
    assert "77" in {r["k"] for r in hot} and len(hot) < 20


def test_incremental_run_survives_failure(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, "k string, v int")
    inc = merkle.IncrementalRun(spark, str(tmp_path / "state"), "k", ["v"], 8)
    assert inc.run(table([("a", 1), ("b", 1), (None, 1)]), lambda d: d) == 1
    nxt = table([("a", 1), ("b", 2), ("c", 1), ("c", 1), (None, 1)])

    def crash():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        inc.run(nxt, lambda d: d, crash)
    assert inc.version() == 1  # what the failed run wrote counts for nothing
    assert inc.run(nxt, lambda d: d) == 2
    assert sorted((r["k"] or "", r["v"]) for r in inc.output().collect()) == [("", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 1)]
    assert inc.run(nxt, lambda d: d) == 3 and inc.output().count() == 6  # nothing new, nothing repeated


def test_deleted_keys_concurrent_runs_and_growth(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, "k string, v int")
    inc = merkle.IncrementalRun(spark, str(tmp_path / "state"), "k", ["v"])
    inc.run(table([("a", 1), ("b", 1), (None, 1)]), lambda d: d)

    def overtaken():
        merkle.IncrementalRun(spark, inc.dir, "k", ["v"]).run(table([("a", 1)]), lambda d: d)

    with pytest.raises(RuntimeError):
        inc.run(table([("z", 9)]), lambda d: d, overtaken)
    assert inc.version() == 2 and sorted(r["k"] or "" for r in inc.deleted().collect()) == ["", "b"]
    many = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    assert inc.run(many, lambda d: d) == 3 and inc.output().count() == 3 + 20_000  # a deeper tree than the saved one
    assert inc.run(many.unionByName(table([("new", 1)])), lambda d: d) == 4 and inc.output().count() == 3 + 20_001
    assert [merkle.bits_for(n) for n in (0, 4096, 5000, 10**6, 10**7, 10**12)] == [4, 4, 8, 12, 16, 28]


def test_numbers_beyond_a_double_are_rescued(spark):
    schema = spark.createDataFrame([("k", "n", "number", False)], "kind string, field string, json_type string, required boolean")
    texts = ["9007199254740993", "9007199254740992", "2.0", "1.25", "0.1234567890123456789", "1e3", "null"]
    rows = spark.createDataFrame([(f'{{"n": {t}}}', "k", "p") for t in texts], "payload string, type string, path string")
    got = [(r["f_n"], r["_rescued"], r["_nulls"]) for r in drift.ingest(rows, schema).collect()]
    assert got == [(None, '{"n":9007199254740993}', []), (9007199254740992.0, None, []), (2.0, None, []), (1.25, None, []), (None, '{"n":0.1234567890123456789}', []), (1000.0, None, []), (None, None, ["n"])]
    assert drift.departures(rows, schema).count() == 0
