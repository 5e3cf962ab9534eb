"""The meaning lane: chunks, vectors, similarity, fusion, and the index that is built step by step."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import filters
from tidemark.session import materialise

RRF_K = 5
CHUNK = "array<struct<ordinal:bigint,start_offset:bigint,end_offset:bigint,text:string>>"


def record_text(title, body):
    """What is embedded of a row: its body, led by the title unless the body begins with it."""
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    return F.when(b.startswith(t), b).otherwise(F.concat_ws("\n", t, b))


def top_k(vectors: DataFrame, query: list[float], k: int, vec: str = "vec", key: str = "doc_id", floor: float | None = None) -> DataFrame:
    """(key, sim) of the k most similar rows; a take-ordered, no shuffle of vectors."""
    sim = vectors.select(key, V.cosine(F.col(vec), V.literal(query)).alias("sim")).filter("sim is not null")
    if floor is not None:
        sim = sim.filter(F.col("sim") >= floor)
    return sim.orderBy(F.desc("sim"), key).limit(k)


def best_chunk(chunks: DataFrame, query: list[float]) -> DataFrame:
    """(project, doc_id, sim, start_offset, end_offset): the best piece of each document, the first of equal ones."""
    sim = chunks.withColumn("sim", V.cosine(F.col("vec"), V.literal(query))).filter("sim is not null")
    best = sim.groupBy("project", "doc_id").agg(F.max(F.struct("sim", (-F.col("ordinal")).alias("o"), "start_offset", "end_offset")).alias("m"))
    return best.select("project", "doc_id", "m.sim", "m.start_offset", "m.end_offset")


def fuse(lanes: dict[str, DataFrame], key: str = "id", k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of lanes (key, place from 0): (key, score, lanes)."""
    parts = [df.select(key, (1.0 / (k + F.col("place"))).alias("s"), F.lit(name).alias("lane")) for name, df in lanes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("s").alias("score"), F.array_join(F.sort_array(F.collect_set("lane")), ",").alias("lanes"))


def placed(df: DataFrame, *order) -> DataFrame:
    """place = 0, 1, ... in order; for ranked pages, whose rows are few."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def placed_all(df: DataFrame, *order) -> DataFrame:
    """As `placed`, for any number of rows: ranges of the order are numbered apart, then moved on by what the ranges before hold. order must not leave ties."""
    ranged = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    size = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(size), "_part").withColumn("place", within - 1 + F.col("_before")).drop("_part", "_before")


def coverage(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(project, eligible, indexed, complete, missing): how much of the eligible rows the index holds."""
    have = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("vec").isNotNull()).alias("good"))
    rows = docs.filter(filters.indexable()).select("id", "project").join(have, F.col("id") == F.col("doc_id"), "left")
    return rows.groupBy("project").agg(
        F.count("*").alias("eligible"), F.count_if(F.col("n").isNotNull()).alias("indexed"), F.count_if(F.col("n") == F.col("good")).alias("complete"), F.count_if(F.col("n").isNull()).alias("missing")
    )


def missing_vectors(docs: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Eligible rows without a vector of the model."""
    return docs.filter(filters.indexable()).join(vectors.filter((F.col("model") == model) & F.col("vec").isNotNull()).select(F.col("doc_id").alias("id")), "id", "left_anti")


def pieces(text: str, limit: int = 2048, overlap: int = 256, earliest: int = 1500) -> list[tuple[int, int]]:
    """Stretches of at most `limit` characters, ended after a blank line if one is late enough."""
    out, s = [], 0
    while s < len(text):
        e = min(s + limit, len(text))
        if e < len(text):
            at = text.rfind("\n\n", s + earliest, e)
            e = at + 2 if at >= 0 else e
        out.append((s, e))
        if e == len(text):
            break
        s = e - overlap
    return out


def chunked(docs: DataFrame, limit: int = 2048) -> DataFrame:
    """(id, ordinal, start_offset, end_offset, text): pieces of each row's text; short texts never leave the JVM."""
    t = docs.select("id", record_text(F.col("title"), F.col("body")).alias("t")).filter("t <> ''")
    short = t.filter(F.length("t") <= limit).select("id", F.lit(0).cast("bigint").alias("ordinal"), F.lit(0).cast("bigint").alias("start_offset"), F.length("t").cast("bigint").alias("end_offset"), F.col("t").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, k, s, e, x[s:e]) for i, x in zip(pdf["id"], pdf["t"]) for k, (s, e) in enumerate(pieces(x, limit))]
            yield pd.DataFrame(out, columns=["id", "ordinal", "start_offset", "end_offset", "text"])

    return short.unionByName(t.filter(F.length("t") > limit).mapInPandas(run, "id bigint, ordinal bigint, start_offset bigint, end_offset bigint, text string"))


def hashing_encoder(width: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic encoder without a model: signed hashes of words, for tests and offline use."""

    def encode(texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        out = []
        for t in texts:
            v = [0.0] * width
            for w in re.findall(r"[^\W_]+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % width] += 1.0 if h & 0x10000 else -1.0
            out.append(v)
        return out

    return encode


def build_index(docs: DataFrame, index: DataFrame | None, encoder: Callable[[list[str]], list[list[float]]], model: str, batch: int = 32) -> DataFrame:
    """Rows to append to an index (id, sha, model, total, ordinal, start_offset, end_offset, vec): those not yet complete there.

    A document counts as done when all of its pieces are there under its present sha and model, so a run
    that was cut short goes on where it stopped.
    """
    wanted = docs.filter(filters.indexable()).select("id", "sha", "title", "body")
    if index is not None:
        done = index.groupBy("id", "sha", "model").agg(F.count_distinct("ordinal").alias("n"), F.max("total").alias("total")).filter("n = total").filter(F.col("model") == model)
        wanted = wanted.join(done.select("id", "sha"), ["id", "sha"], "left_anti")
    parts = chunked(wanted)
    total = parts.groupBy("id").agg(F.count("*").alias("total"))
    rows = parts.join(total, "id").join(wanted.select("id", "sha"), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vecs = []
            for at in range(0, len(pdf), batch):
                vecs += encoder(pdf["text"].iloc[at : at + batch].tolist())
            yield pdf.drop(columns="text").assign(vec=vecs)

    return rows.select("id", "sha", F.lit(model).alias("model"), "total", "ordinal", "start_offset", "end_offset", "text").mapInPandas(
        run, "id bigint, sha string, model string, total bigint, ordinal bigint, start_offset bigint, end_offset bigint, vec array<float>"
    )
