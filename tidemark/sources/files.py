"""Files on their way in: selection, fingerprints, resumption, projects, receipts."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import merkle

#: Fixed value: bytes of a file's head that identify it.
HEAD = 4096


@dataclass
class Selector:
    """What of the input a run takes: all, one session, a range of days (both inclusive, UTC), or what is new."""

    kind: str = "new"
    session: str | None = None
    since: str | None = None
    until: str | None = None

    def __post_init__(self):
        if self.kind not in ("all", "new", "session", "range"):
            raise ValueError(f"no such selection: {self.kind}")
        if (self.kind == "session") != bool(self.session):
            raise ValueError("a session is selected by its id")
        if self.kind != "range" and (self.since or self.until):
            raise ValueError("days go with a range")

    def moves_checkpoints(self) -> bool:
        return self.kind in ("all", "new")

    def where(self, rows: DataFrame) -> DataFrame:
        if self.kind == "session":
            return rows.filter(F.col("session_id") == self.session)
        if self.kind == "range":
            lo, hi = dates.date_range("UTC", since=self.since, until=self.until)
            ms = dates.event_ms(F.col("ts"))
            return rows.filter((ms >= lo if lo is not None else F.lit(True)) & (ms < hi if hi is not None else F.lit(True)))
        return rows


def fingerprints(spark: SparkSession, glob: str, span: int = HEAD) -> DataFrame:
    """(path, size, mtime, sha): hash of each file's first bytes. Reads whole files; meant for transcripts listed as changed."""
    f = spark.read.format("binaryFile").load(glob)
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2(F.substring("content", 1, span), 256).alias("sha"))


def resume(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, from_offset, size, action): append (go on), new, or rewrite (supersede what came from the path and read it again)."""
    todo = merkle.pending_files(files, sources)
    known = sources.select("path", F.lit(True).alias("known"))
    action = F.when(F.col("from_offset") > 0, "append").when(F.col("known"), "rewrite").otherwise("new")
    return todo.join(known, "path", "left").select("path", "from_offset", "size", action.alias("action"))


def moved(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(old_path, new_path) of files whose record's path is gone and whose base name is listed under another."""
    listed = merkle.listing(files).select(F.col("path").alias("new_path"), "base", "sha")
    gone = merkle.checkpoints(sources).join(listed.select(F.col("new_path").alias("path")), "path", "left_anti").select(F.col("path").alias("old_path"), "base", "sha")
    fresh = listed.join(sources.select(F.col("path").alias("new_path")), "new_path", "left_anti")
    return gone.join(fresh, ["base", "sha"]).groupBy("old_path").agg(F.min("new_path").alias("new_path"))


def normal_repo(url: Column) -> Column:
    """host/owner/name of a remote, however it is written."""
    s = F.lower(F.trim(url))
    s = F.regexp_replace(s, r"^(?:[a-z+]+://)?(?:[^@/]+@)?", "")
    return F.regexp_replace(F.regexp_replace(s, r"^([^/:]+):(?:\d+/)?", "$1/"), r"(?:\.git)?/*$", "")


def bind(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """sessions (session_id, cwd, repo) with project and why: the longest root that holds cwd, else the same remote, else unresolved.

    roots (project, root, repo) come from configuration; the join is on the leading folders of cwd, so it needs no product.
    """
    slashed = F.regexp_replace(F.translate(F.coalesce("cwd", F.lit("")), "\\", "/"), "/+$", "")
    parts = F.split("_cwd", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    s = sessions.withColumn("_cwd", slashed)
    r = roots.select(F.regexp_replace(F.translate("root", "\\", "/"), "/+$", "").alias("_root"), F.col("project").alias("_p"))
    held = s.select("session_id", "_cwd", F.explode(above).alias("_root")).join(r, "_root").groupBy("session_id").agg(F.max_by("_p", F.struct(F.length("_root"), "_p")).alias("by_root"))
    same = s.select("session_id", normal_repo(F.col("repo")).alias("_repo")).join(roots.select(normal_repo(F.col("repo")).alias("_repo"), F.col("project").alias("_p")), "_repo").groupBy("session_id").agg(F.min("_p").alias("by_repo"), F.count_distinct("_p").alias("n"))
    out = s.join(held, "session_id", "left").join(same, "session_id", "left")
    repo = F.when(F.col("n") == 1, F.col("by_repo"))
    return out.select(
        *sessions.columns, F.coalesce("by_root", repo).alias("project"), F.when(F.col("by_root").isNotNull(), "folder").when(repo.isNotNull(), "remote").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("why")
    )


def receipt(kind: str, **counts: int | str | None) -> str:
    """One line of a run's audit trail."""
    return json.dumps({"kind": kind, **counts}, sort_keys=True)
