"""Changes of state as pure functions of snapshots: insert once, supersede, strike, link, deduplicate, upsert.

Nothing is updated in place: each function gives the table's next state, which `snapshots.publish` makes
current at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text

SEP = "\u0001"


def content_sha(*parts: Column) -> Column:
    """Identity of a row: the hash of its parts, nulls as empty."""
    return F.sha2(F.concat_ws(SEP, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def first_of_each(rows: DataFrame, key: str, order: str | list[str] = "id") -> DataFrame:
    """The first row of each key by order; rows without a key are all kept."""
    w = Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order))
    keyed = rows.filter(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
    return keyed.unionByName(rows.filter(F.col(key).isNull()))


def insert_once(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, occurrences (doc_id, path, src_offset) of messages seen again elsewhere)."""
    known = existing.select("sha", F.col("id").alias("_known"), F.col("path").alias("_kp"))
    fresh = first_of_each(new.join(known.select("sha"), "sha", "left_anti"), "sha")
    holders = known.unionByName(fresh.select("sha", F.col("id").alias("_known"), F.col("path").alias("_kp")))
    again = new.join(holders, "sha").filter((F.col("id") != F.col("_known")) & ~F.col("path").eqNullSafe(F.col("_kp")))
    return fresh, again.select(F.col("_known").alias("doc_id"), "path", "src_offset").dropDuplicates(["doc_id", "path"])


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert: of all versions of a key the latest by order."""
    cols = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_v"))
    return last.select(*keys, *[F.col("_v")[c].alias(c) for c in cols])


def move_path(rows: DataFrame, old: str, new: str) -> DataFrame:
    return rows.withColumn("path", F.when(F.col("path") == old, new).otherwise(F.col("path")))


def supersede_path(docs: DataFrame, path: str) -> DataFrame:
    return docs.withColumn("status", F.when((F.col("path") == path) & (F.col("status") == "active"), "superseded").otherwise(F.col("status")))


def supersede_beyond(docs: DataFrame, path: str, offset: int) -> DataFrame:
    hit = (F.col("path") == path) & (F.col("kind") == "turn") & (F.col("src_offset") >= offset) & (F.col("status") == "active")
    return docs.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status")))


def reactivate(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Superseded rows of the ids (id) become active and lose their pointer; struck ones stay struck."""
    hit = F.col("_hit").isNotNull() & (F.col("status") == "superseded")
    out = docs.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return out.withColumns({"status": F.when(hit, "active").otherwise(F.col("status")), "superseded_by": F.when(hit, None).otherwise(F.col("superseded_by"))}).drop("_hit").select(*docs.columns)


def strike(docs: DataFrame, id_: int, day: str, note: str = "") -> DataFrame:
    line = f"struck {day}" + (f": {note}" if note else "")
    hit = F.col("id") == id_
    return docs.withColumns({"status": F.when(hit, "struck").otherwise(F.col("status")), "body": F.when(hit, F.concat_ws("\n", "body", F.lit(line))).otherwise(F.col("body"))})


def unstrike(docs: DataFrame, id_: int) -> DataFrame:
    hit = (F.col("id") == id_) & (F.col("status") == "struck")
    rest = F.array_join(F.filter(F.split("body", "\n"), lambda x: ~x.startswith("struck ")), "\n")
    return docs.withColumns({"status": F.when(hit, "active").otherwise(F.col("status")), "body": F.when(hit, rest).otherwise(F.col("body"))})


def link_sections(docs: DataFrame) -> DataFrame:
    """Superseded note sections point to the newest active one of the same path, kind and title."""
    key = ["path", "kind", "title"]
    live = docs.filter((F.col("status") == "active") & (F.col("kind") != "turn")).groupBy(*key).agg(F.max("id").alias("_to"))
    hit = (F.col("status") == "superseded") & F.col("superseded_by").isNull() & F.col("_to").isNotNull()
    return docs.join(live, key, "left").withColumn("superseded_by", F.when(hit, F.col("_to")).otherwise(F.col("superseded_by"))).select(*docs.columns)


def merge_note(docs: DataFrame, sections: DataFrame, path: str) -> DataFrame:
    """A note read again: unchanged sections (by sha) stay or come back under their id, others of the path are superseded, new ones are appended and linked."""
    same = sections.select("sha", F.lit(True).alias("_now"))
    out = docs.join(same.distinct(), "sha", "left")
    here = F.col("path") == path
    status = (
        F.when(here & F.col("_now") & (F.col("status") == "superseded"), "active").when(here & F.col("_now").isNull() & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    )
    pointer = F.when(here & F.col("_now"), None).otherwise(F.col("superseded_by"))
    out = out.withColumns({"superseded_by": pointer, "status": status}).select(*docs.columns)
    fresh = first_of_each(sections.join(docs.select("sha"), "sha", "left_anti"), "sha")
    return link_sections(out.unionByName(fresh.select(*docs.columns)))


def last_evidence() -> Column:
    return F.array_max(F.from_json("evidence_ids", "array<bigint>"))


def dedupe_statements(docs: DataFrame) -> DataFrame:
    """Of statements with the same session, last evidence, outcome and quote the newest stays; the older point to it.

    Quotes are alike but for white space and composition, not for case; an empty quote is like no other. Statements of no session are left alone.
    """
    q = text.quote_key(F.col("quote"))
    turn = last_evidence()
    able = (F.col("kind") == "statement") & (F.col("status") == "active") & F.col("session_id").isNotNull() & (q != "") & turn.isNotNull()
    rows = docs.filter(able).select("id", "session_id", turn.alias("turn"), "outcome", q.alias("q"))
    key = ["session_id", "turn", "outcome", "q"]
    newest = rows.groupBy(*key).agg(F.max("id").alias("keep"), F.count("*").alias("n")).filter("n > 1").toDF(*["k_" + k for k in key], "keep", "n")
    same = rows["session_id"] == newest["k_session_id"]
    for k in key[1:]:
        same = same & rows[k].eqNullSafe(newest["k_" + k])
    moves = rows.join(newest, same).select("id", "keep").filter("id <> keep")
    out = docs.join(moves, "id", "left")
    hit = F.col("keep").isNotNull()
    return out.withColumns({"status": F.when(hit, "superseded").otherwise(F.col("status")), "superseded_by": F.when(hit, F.col("keep")).otherwise(F.col("superseded_by"))}).select(*docs.columns)


def supersede_by_evidence(docs: DataFrame, session: str, lo: int, hi: int, origin: str | None = None, tag: str | None = None) -> DataFrame:
    """Active statements of a session whose last evidence lies in [lo, hi] are superseded; only of one origin if given. Those that the prompt of path `tag` made stay."""
    hit = (F.col("kind") == "statement") & (F.col("status") == "active") & (F.col("session_id") == session) & last_evidence().between(lo, hi)
    if origin:
        hit = hit & (F.col("origin") == origin)
    if tag is not None:
        hit = hit & (F.col("path").isNull() | (F.col("path") != tag))
    return docs.withColumn("status", F.when(F.coalesce(hit, F.lit(False)), "superseded").otherwise(F.col("status")))


def point_to_stronger(docs: DataFrame) -> DataFrame:
    """Superseded statements point to the newest active one about the same turn of the same session."""
    best = docs.filter("kind = 'statement' and status = 'active'").select("session_id", last_evidence().alias("_turn"), "id").groupBy("session_id", "_turn").agg(F.max("id").alias("_to"))
    out = docs.withColumn("_turn", last_evidence()).join(best, ["session_id", "_turn"], "left")
    hit = (F.col("kind") == "statement") & (F.col("status") == "superseded") & F.col("superseded_by").isNull()
    return out.withColumn("superseded_by", F.when(hit, F.coalesce("_to", "superseded_by")).otherwise(F.col("superseded_by"))).select(*docs.columns)


def point_replaced(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each replaced statement points to its first replacement: of its edges (old_id, new_id) the one with the earliest ts."""
    new = docs.select(F.col("id").alias("new_id"), F.col("ts").alias("_ts"))
    first = verdicts.join(new, "new_id").groupBy("old_id").agg(F.min_by("new_id", F.struct("_ts", "new_id")).alias("_to"))
    return docs.join(first, F.col("id") == F.col("old_id"), "left").withColumn("superseded_by", F.coalesce("_to", "superseded_by")).select(*docs.columns)
