import json

from pyspark.sql import functions as F

from tidemark.llm import conversations as C
from tidemark.session import read

S = "id bigint, kind string, status string, session_id string, sha string, ts string, path string, src_offset bigint, role string, body string, ms string"


def docs(spark, *rows):
    return spark.createDataFrame([(r[0], r[5] if len(r) > 5 else "turn", "active", r[1], r[6] if len(r) > 6 else f"s{r[0]}", r[2], "p", r[0], r[3], r[4], "clash") for r in rows], S)


def sources(spark):
    return spark.createDataFrame([("p", json.dumps({"tz": "Europe/Berlin"}), None)], "path string, state string, ingested_at string")


T = "2026-01-01T10:00:%02dZ"
ROWS = [
    (1, "good", T % 0, "USER", "a"), (3, "good", T % 1, "assistant", "b"), (2, "good", T % 2, "user", "c"), (9, "good", T % 3, "Assistant", "d"), (10, "good", "2026-01-01T11:00:02", "user", "late copy", "turn", "s2"),
    (20, "empty", T % 0, "user", "[image] \n"), (21, "empty", "nonsense", "odd", "(tool-only turn: x) y"), (22, "empty", T % 0, "user", None),
    (30, "notime", T % 0, "user", "a"), (31, "notime", None, "assistant", "b"), (40, "role", T % 0, "user", "a"), (41, "role", T % 1, "", "b"), (50, "first", T % 0, "assistant", "a"),
    (60, "open", T % 0, "user", "a"), (61, "open", T % 1, "user", "b"), (62, "open", T % 2, "assistant", "c"), (70, "tail", T % 0, "user", "a"), (71, "tail", T % 1, "assistant", "b"), (72, "tail", T % 2, "user", "c"),
    (80, "tie", T % 0, "user", "a"), (81, "tie", T % 0, "assistant", "b"), (90, None, T % 0, "odd", "a"), (91, "local", "2026-01-01 11:00:00", "user", "x" * 200_000), (92, "local", T % 1, "assistant", "y"), (95, "note", T % 1, "odd", "y", "memory"),
]


def test_defects(spark):
    got = {r["session_id"]: r["defect"] for r in C.defects(docs(spark, *ROWS), sources(spark)).collect()}
    assert got == {"empty": "empty", "notime": "broken", "role": "broken", "first": "broken", "open": "no_reply", "tail": "no_reply"}


def test_conversations_in_order(spark):
    got = [(r["session_id"], r["turn_no"], r["id"], r["role"]) for r in C.conversations(docs(spark, *ROWS), sources(spark)).orderBy("session_id", "turn_no").collect()]
    assert got == [("good", 1, 1, "user"), ("good", 2, 3, "assistant"), ("good", 3, 2, "user"), ("good", 4, 9, "assistant"), ("local", 1, 91, "user"), ("local", 2, 92, "assistant"), ("tie", 1, 80, "user"), ("tie", 2, 81, "assistant")]


def test_empty_table(spark):
    assert C.defects(docs(spark, *ROWS).limit(0), sources(spark)).count() == 0


def test_one_session_over_many_slots(spark):
    """A session that holds all rows is split, and comes out as if it were not."""
    n = 3000
    rows = spark.range(n).select(F.lit("s").alias("session_id"), ((F.col("id") * 7919) % n).alias("id")).withColumn("ms", F.col("id") * 600_000)
    rows = rows.select("session_id", "id", "ms", F.when(F.col("id") % 2 == 0, "u").otherwise("a").alias("role"), F.lit(True).alias("spoken"))
    segs = C.segments(rows, batches=2).cache()
    assert segs.count() > 3 and segs.agg(F.sum(F.size("said"))).first()[0] == n
    assert [tuple(r) for r in C.verdicts(segs).collect()] == [("s", None, n)]
    assert C.verdicts(C.segments(rows.filter("id <> 1501"), batches=2)).first()["defect"] == "no_reply"


def test_against_brute_force(spark, sf):
    from tidemark.operators.timestamps import normalise

    d, src = read(spark, sf, "docs"), read(spark, sf, "sources")
    at = {r["id"]: r["utc_ms"] for r in normalise(d.select("id", "ts", "path", "src_offset"), "ts", "path", "src_offset", src, estimate=False).collect()}
    turns, seen = {}, set()
    for r in d.filter("kind = 'turn' and status = 'active' and session_id is not null").orderBy("id").collect():
        if r["sha"] in seen:
            continue
        seen.add(r["sha"])
        said = turns.setdefault(r["session_id"], [])
        if r["body"] and not r["body"].startswith("(tool-only turn:") and r["body"].replace("[image]", "").strip(" \t\r\n"):
            said.append((at[r["id"]], r["id"], (r["role"] or "").lower()))
    want = {}
    for s, m in turns.items():
        if not m:
            want[s] = "empty"
        elif any(x[0] is None or x[2] not in ("user", "assistant") for x in m) or sorted(m)[0][2] != "user":
            want[s] = "broken"
        else:
            roles = [x[2] for x in sorted(m)] + [None]
            if any(a == "user" and b != "assistant" for a, b in zip(roles, roles[1:])):
                want[s] = "no_reply"
    assert {r["session_id"]: r["defect"] for r in C.defects(d, src).collect()} == want


def test_live_stream_with_a_stated_delay(spark, tmp_path):
    """Segments leave a live stream, with their verdicts, once the watermark is past their window; a message within the delay still joins, a later one is dropped."""
    import datetime as dt

    from tidemark.llm import conversations as C

    day = lambda d: dt.datetime(2026, 1, d, tzinfo=dt.timezone.utc)
    message = lambda i, d, role: ("s", 0, i, int(day(d).timestamp() * 1000), role, True, day(d))
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for batch in ([message(1, 1, "u"), message(3, 9, "u")], [message(2, 2, "a")], [message(4, 30, "u")], [message(5, 3, "a"), message(6, 31, "a")]):
        spark.createDataFrame(batch, C._MESSAGE).coalesce(1).write.mode("append").parquet(inbox)
        arriving = spark.readStream.schema(C._MESSAGE).parquet(inbox)
        q = C.closing(arriving, "10 days").writeStream.outputMode("append").format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["begins"], [m["id"] for m in r["said"]], r["n"], r["bad"], r["open"], r["first"], r["last"]) for r in spark.read.parquet(out).collect())
    assert [g[1:] for g in got] == [([1, 2], 2, False, False, "u", "a"), ([3], 1, False, False, "u", "u")]
