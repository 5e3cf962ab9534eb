"""Counts and overviews of the document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import filters


def units(docs: DataFrame) -> DataFrame:
    session = F.when(F.col("session_id").isNotNull(), F.concat_ws(":", F.coalesce("source_client", F.lit("")), "session_id"))
    return docs.agg(F.count("*").alias("records"), F.count_if(F.col("kind") == "turn").alias("messages"), F.count_distinct(session).alias("sessions"), F.count_if(F.col("kind") == "statement").alias("decisions"))


def sessions(docs: DataFrame) -> DataFrame:
    ms = dates.event_ms(F.col("ts"))
    return docs.filter("session_id is not null").groupBy("source_client", "session_id").agg(F.count("*").alias("records"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))


def coverage(docs: DataFrame) -> DataFrame:
    ms = dates.event_ms(F.col("ts"))
    return docs.groupBy("source_client", "kind").agg(F.count("*").alias("records"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"), F.count_if(ms.isNull()).alias("undated"))


def recent_sessions(docs: DataFrame, n: int, client: str | None = None) -> DataFrame:
    rows = docs.filter((F.col("kind") == "turn") & filters.live() & F.col("session_id").isNotNull())
    if client:
        rows = rows.filter(F.col("source_client") == client)
    return rows.groupBy("session_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("turns")).orderBy(F.desc("last_ts"), "session_id").limit(n)


def revision(docs: DataFrame) -> DataFrame:
    """One hash over all rows, whatever their order: sums of row hashes, so nothing is sorted or gathered."""
    h = F.xxhash64(*[F.col(c) for c in sorted(docs.columns)])
    return docs.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string"), F.coalesce(F.bit_xor(h), F.lit(0)).cast("string")), 256).alias("revision"))


def sizing(docs: DataFrame) -> DataFrame:
    """What an index over the eligible rows would hold: rows, characters, bytes."""
    return docs.filter(filters.indexable()).agg(F.count("*").alias("records"), F.sum(F.length("body")).alias("chars"), F.sum(F.octet_length("body")).alias("bytes"))


def mentions(files: list[str]) -> Column:
    """Whether a row names one of the files: among its own by the end of the path, or in its text by a base name of more than five characters."""
    own = F.transform(F.coalesce(F.from_json("files_json", "array<string>"), F.array().cast("array<string>")), lambda x: F.translate(x, "\\", "/"))
    said, hit = F.concat_ws(" ", "title", "body"), F.lit(False)

    def ends_with(name: str):
        return lambda x: F.coalesce(x.endswith(name), F.lit(False))

    for f in (f.replace("\\", "/") for f in files):
        base = f.rsplit("/", 1)[-1]
        hit = hit | F.exists(own, ends_with(f)) | (F.contains(said, F.lit(base)) if len(base) > 5 else F.lit(False))
    return F.coalesce(hit, F.lit(False))


def brief(docs: DataFrame, recent: int = 3, lines: int = 20, files: list[str] | None = None) -> DataFrame:
    """(id, ts, who, outcome, title, score): recent statements and handoffs, the most telling first. files: those touched of late; rows that name one come forward."""
    last, touched = recent_sessions(docs, recent).select("session_id"), mentions(files or [])
    stmts = docs.filter((F.col("kind") == "statement") & filters.live() & (F.coalesce("outcome", F.lit("")) != "standing")).join(last, "session_id", "left_semi").select("id", "ts", "who", "outcome", "title", touched.alias("_t"))
    notes = docs.filter((F.col("kind") == "handoff") & filters.live()).select("id", "ts", F.lit("handoff").alias("who"), F.lit("note").alias("outcome"), "title", touched.alias("_t"))
    rows = stmts.unionByName(notes).withColumn("ms", dates.event_ms(F.col("ts")))
    oldest = docs.filter((F.col("kind") == "turn") & filters.live()).join(last, "session_id", "left_semi").agg(F.min(dates.event_ms(F.col("ts"))).alias("t0"))
    age = F.greatest(F.lit(0.0), (F.coalesce("ms", "t0") - F.coalesce("t0", "ms")) / 86_400_000)
    score = F.when(F.col("_t"), 3).otherwise(0) + F.when(F.col("outcome") == "open", 2).when(F.col("outcome") == "rejected", 1).otherwise(0) + F.coalesce(age, F.lit(0.0))
    out = rows.crossJoin(F.broadcast(oldest)).withColumn("score", F.round(score, 6))
    return out.orderBy(F.desc("score"), (F.col("outcome") == "open").desc(), "id").limit(lines).select("id", "ts", "who", "outcome", "title", "score")
