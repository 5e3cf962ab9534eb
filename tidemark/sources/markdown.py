"""Versioned Markdown notes as sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lifecycle import content_sha

# Where a note of a kind is cut, and how a section begins.
CUTS = {"changelog": r"\n(?=\*\*\d{4}-\d{2}-\d{2})", "map_section": r"\n(?=#{2,3} )"}
NOTE = r"\n(?=## )"


def read_notes(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def front_matter(content: Column) -> tuple[Column, Column]:
    """(map of keys to values, the rest); an absent block gives an empty map and the whole text."""
    block = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"
    inner = F.regexp_extract(content, block, 1)
    lines = F.filter(F.split(inner, r"\r?\n"), lambda x: x.rlike(r"^\s*[\w-]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*([\w-]+):", 1).alias("k"), F.trim(F.regexp_extract(x, r"^\s*[\w-]+:\s*(.*)$", 1)).alias("v")))
    # Of a key given twice the last counts.
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    meta = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))
    return F.when(content.rlike(block), meta).otherwise(F.create_map().cast("map<string,string>")), F.regexp_replace(content, block, "")


def sections(notes: DataFrame, kind: str, content: str = "content") -> DataFrame:
    """notes' rows, one per section with a body: place, title, section, ts (of dated entries)."""
    plain = F.regexp_replace(content, "\r\n", "\n")
    cut = notes.select("*", F.posexplode(F.split(plain, CUTS.get(kind, NOTE))).alias("place", "_s")).withColumn("_s", F.trim(F.regexp_replace("_s", r"^\s+|\s+$", "")))
    if kind == "changelog":
        head = r"(?s)^\*\*(\d{4}-\d{2}-\d{2})\s*[,:]?\s*([^*]+)\*\*.*"
        out = cut.filter(F.col("_s").rlike(head))
        return out.select(*notes.columns, "place", F.trim(F.regexp_extract("_s", head, 2)).alias("title"), F.col("_s").alias("section"), F.concat(F.regexp_extract("_s", head, 1), F.lit("T00:00:00.000Z")).alias("ts"))
    head = (r"(?s)^#{2,3} +" if kind == "map_section" else r"(?s)^## +") + r"([^\n]+)\n?(.*)$"
    out = cut.filter(F.col("_s").rlike(head)).withColumn("section", F.regexp_replace(F.regexp_extract("_s", head, 2), r"^\s+|\s+$", "")).filter("section <> ''")
    return out.select(*notes.columns, "place", F.trim(F.regexp_extract("_s", head, 1)).alias("title"), "section", F.lit(None).cast("string").alias("ts"))


def section_rows(notes: DataFrame, kind: str, project: str) -> DataFrame:
    """Sections as rows of the document table (without id)."""
    s = sections(notes, kind)
    return s.select(
        F.lit(project).alias("project"), F.lit(kind).alias("kind"), F.lit("active").alias("status"), "path", "title", F.col("section").alias("body"), "ts", F.lit("file").alias("origin"),
        content_sha(F.lit(project), F.lit(kind), F.col("path"), F.col("title"), F.col("section")).alias("sha"),
    )
