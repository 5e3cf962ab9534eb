"""Conversations from message rows (problem 1).

Messages arrive in micro-batches and are kept in keyed streaming state, one entry per session, slot and
event-time window, until the watermark closes the window; late ones are buffered there. A closed window
leaves the stream as one segment (`closing`): its messages in order, and its verdict: how many there are,
whether one is broken, whether a user's message in it is unanswered, and the roles at its two ends. The
verdicts of a session's segments, narrow rows without messages, are then folded, which decides whether the
conversation is whole.

A slot is a range of the order (session, instant, id), cut so that slots hold about equally many
messages, SLOT_ROWS at most. Slots of one session follow each other in time, so a session of any size is
spread over as many state entries as it needs, and no entry grows without bound.

A live caller states the watermark's delay and hands `closing` its stream. Input that ends (`segments`) has no
such delay of its own: unless one is stated it is taken from the arrival batches, so that no message comes
too late for its window, and a marker far in the future is the timeout that closes what is open. The number of
rows Spark dropped as late is checked after each run, and a run that dropped any fails.

Defined cases: rows without session_id belong to no conversation; a null sha is no sha, such rows are
never copies of each other; a null body or role is not spoken or not of a known role; messages at the
same instant follow by id; an empty table gives no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.timestamps import normalise
from tidemark.session import materialise, shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOOL_ONLY = "(tool-only turn:"
#: Messages that a slot should hold at most.
SLOT_ROWS = 50_000
_MESSAGE = "session_id string, slot int, id bigint, ms bigint, role string, spoken boolean, at timestamp"


def is_spoken(body: Column) -> Column:
    return F.coalesce(~body.startswith(TOOL_ONLY) & F.replace(body, F.lit("[image]"), F.lit("")).rlike(r"[^ \t\r\n]"), F.lit(False))


def messages(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(session_id, id, ms, role u/a/x, spoken) of active turns, the smallest id of each sha."""
    docs = docs.select("id", "kind", "status", "session_id", "sha", "ts", "path", "src_offset", "role", "body")
    turns = docs.filter((F.col("kind") == "turn") & (F.col("status") == "active") & F.col("session_id").isNotNull() & F.col("id").isNotNull())
    # Only shas delivered more than once matter, and only their hashes and least ids are shuffled for it.
    again = materialise(
        turns.filter("sha is not null").groupBy(F.col("sha").alias("_sha")).agg(F.min("id").alias("_least"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "delivered-again"
    )
    once = turns.join(again, (F.col("sha") == F.col("_sha")) & (F.col("id") > F.col("_least")), "left_anti")
    low = F.lower("role")
    rows = once.select(
        "session_id", "id", "ts", "path", "src_offset", F.when(low == "user", "u").when(low == "assistant", "a").otherwise("x").alias("role"), is_spoken(F.col("body")).alias("spoken")
    )
    return normalise(rows, "ts", "path", "src_offset", sources, estimate=False).select("session_id", "id", F.col("utc_ms").alias("ms"), "role", "spoken").dropDuplicates(["id"])


def closing(arriving: DataFrame, delay: str, window_days: int = 7) -> DataFrame:
    """Segments of a stream (or table) of messages, with `_MESSAGE`'s columns, as their windows close `delay` behind the latest message.

    (session_id, slot, begins, said: array<struct<ms,id,role>>, n, bad, open, first, last)
    """
    said = F.collect_list(F.when(F.col("spoken"), F.struct("ms", "id", "role")))
    held = arriving.withWatermark("at", delay).groupBy("session_id", "slot", F.window("at", f"{window_days} days")).agg(F.sort_array(said).alias("said"))
    n, roles = F.size("said"), F.transform("said", lambda m: m["role"])
    return held.select(
        "session_id", "slot", F.col("window.start").alias("begins"), "said", n.alias("n"), F.exists("said", lambda m: m["ms"].isNull() | (m["role"] == "x")).alias("bad"),
        _unanswered(roles, n).alias("open"), F.get(roles, F.lit(0)).alias("first"), F.try_element_at(roles, F.lit(-1)).alias("last"),
    )


def segments(rows: DataFrame, batches: int = 3, window_days: int = 7, close: bool = True, delay_s: int | None = None, n_rows: int = 0) -> DataFrame:
    """What `closing` makes of a table's messages, handed over in batches. n_rows: how many there are at most, for the number of slots."""
    spark = rows.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // SLOT_ROWS))
    ranged = rows.repartitionByRange(slots, "session_id", F.col("ms").asc_nulls_first(), "id").withColumn("slot", F.spark_partition_id())
    staged = materialise(ranged, "messages")
    edges = staged.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000).alias("q"), F.max("ms").alias("top"), F.min("ms").alias("low"), F.count("*").alias("n")).first()
    inbox, state, out = shared_dir(spark, "inbox"), shared_dir(spark, "state"), shared_dir(spark, "segments")
    schema = "session_id string, slot int, begins timestamp, said array<struct<ms:bigint,id:bigint,role:string>>, n int, bad boolean, open boolean, first string, last string"
    if not edges["n"]:
        return spark.createDataFrame([], schema)
    cuts = sorted(set(edges["q"] or []))
    number = sum(((F.col("id") > q).cast("int") for q in cuts), F.lit(0))
    staged = staged.withColumn("batch", number)
    spread = {r["batch"]: (r["low"], r["top"]) for r in staged.groupBy("batch").agg(F.min("ms").alias("low"), F.max("ms").alias("top")).collect()}
    late, seen = 0, None
    for b in sorted(spread):
        low, top = spread[b]
        if seen is not None and low is not None:
            late = max(late, seen - low)
        seen = max(x for x in (seen, top, 0) if x is not None)
    day = 86_400_000
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        marker = spark.createDataFrame([("\u0000", 0, 0, 0, "x", False)], "session_id string, slot int, id bigint, ms bigint, role string, spoken boolean")
        steps = [(staged.filter(F.col("batch") == b).drop("batch"), spread[b][1] or 0) for b in sorted(spread)]
        if close:
            steps.append((marker, (edges["top"] or 0) + late + (window_days + 1) * day))
        for part, stamp in steps:
            end = F.lit(None).cast("bigint") if part is not marker else F.lit(stamp)
            at = F.timestamp_millis(F.coalesce(end, F.col("ms"), F.lit(stamp)))
            part.withColumn("at", at).write.mode("append").parquet(inbox)
            delay = late // 1000 + 1 if delay_s is None else delay_s
            closed = closing(spark.readStream.schema(_MESSAGE).parquet(inbox), f"{delay} seconds", window_days)
            q = closed.writeStream.outputMode("append").format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
            q.awaitTermination()
            if len(q.recentProgress) >= int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100")):
                raise RuntimeError("more batches in one run than are reported; rows dropped as late can't be counted")
            dropped = sum(int(o.get("numRowsDroppedByWatermark", 0)) for p in q.recentProgress for o in p["stateOperators"])
            if dropped:
                raise RuntimeError(f"{dropped} messages came after their window was closed; a larger delay is needed")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    return spark.read.schema(schema).parquet(out).filter(F.col("session_id") != "\u0000")


def _unanswered(pairs_of: Column, n: Column) -> Column:
    """Whether some user message in an ordered array of roles is followed, within it, by none of the assistant."""
    return F.exists(F.zip_with(F.slice(pairs_of, 1, F.greatest(n - 1, F.lit(0))), F.slice(pairs_of, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (a == "u") & (b != "a")), lambda x: x)


def verdicts(segs: DataFrame) -> DataFrame:
    """(session_id, defect, messages); defect is null for a whole conversation."""
    brief = segs.select("session_id", "slot", "begins", "n", "bad", "open", "first", "last")
    part = F.when(F.col("n") > 0, F.struct("slot", "begins", "first", "last"))
    folded = brief.groupBy("session_id").agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.max("bad").alias("bad"), F.max("open").alias("open"), F.sum("n").alias("messages")
    )
    k = F.size("parts")
    seam = F.exists(
        F.zip_with(F.slice("parts", 1, F.greatest(k - 1, F.lit(0))), F.slice("parts", 2, F.greatest(k - 1, F.lit(0))), lambda a, b: (a["last"] == "u") & (b["first"] != "a")), lambda x: x
    )
    defect = (
        F.when(F.col("messages") == 0, "empty")
        .when(F.col("bad") | (F.get("parts", F.lit(0))["first"] != "u"), "broken")
        .when(F.col("open") | seam | (F.try_element_at("parts", F.lit(-1))["last"] == "u"), "no_reply")
    )
    return folded.select("session_id", defect.alias("defect"), F.col("messages").cast("bigint").alias("messages"))


def defects(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(session_id, defect) of every session that is no whole conversation."""
    return verdicts(segments(messages(docs, sources), n_rows=docs.count())).filter("defect is not null").select("session_id", "defect")


def conversations(docs: DataFrame, sources: DataFrame, bodies: bool = True) -> DataFrame:
    """(session_id, turn_no, id, role, utc_ms[, body]) of whole conversations, one row per message in order."""
    segs = materialise(segments(messages(docs, sources), n_rows=docs.count()), "closed")
    good = verdicts(segs).filter("defect is null").select("session_id")
    # Places are counted over narrow rows, one a segment; the messages themselves are not moved for it.
    w = Window.partitionBy("session_id").orderBy("slot", "begins").rowsBetween(Window.unboundedPreceding, -1)
    place = segs.select("session_id", "slot", "begins", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")).join(good, "session_id", "left_semi")
    rows = segs.select("session_id", "slot", "begins", "said").join(place, ["session_id", "slot", "begins"]).select("session_id", "before", F.posexplode("said").alias("k", "m"))
    role = F.when(F.col("m.role") == "u", "user").otherwise("assistant")
    out = rows.select("session_id", (F.col("before") + F.col("k") + 1).cast("bigint").alias("turn_no"), F.col("m.id").alias("id"), role.alias("role"), F.col("m.ms").alias("utc_ms"))
    return out.join(docs.select("id", "body"), "id").select(*out.columns, "body") if bodies else out
