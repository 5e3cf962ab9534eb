"""Long exact spans shared between records (problem 10).

Content-defined chunking: a gear hash (h = 4h + g(c), 32 bits, so 16 characters deep) runs over the
text, and a position is a cut where its hash is the least of some window of WINDOW positions; of equal
ones the last. That depends on the text around it alone, so an insertion moves no cut but those next to
it, and cuts are never further apart than WINDOW. A variable chunk runs from a cut to the first cut at
least REACH characters on, and is known by its digest. With REACH = 202 - 16 - 2 * WINDOW every run of
200 characters contains one whole chunk, so records that share a run always share a digest; every pair
of records with a common digest is then compared character by character.

Whole copies are first brought down to one representative each (a narrow aggregation over digests of
whole texts); the chunks of representatives alone are shuffled, as (digest, record, place).

Defined cases: null and empty texts share nothing; texts shorter than the least span neither; repeated
rows of one id count as one record (its least text); positions are code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

DEEP = 16
WINDOW = 48
#: Records with a common chunk up to which all of them are candidates for each other; beyond, whole runs have to agree.
FEW = 16
_B = 0x9E3779B97F4A7C15 | 1
_CHUNK = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOW = _mix(np.arange(1, 0x3001, dtype=np.uint64) * np.uint64(_B))


def _code(points: np.ndarray) -> np.ndarray:
    """A random 64-bit number per character; characters of the common planes by table, the others computed."""
    out = _LOW[np.minimum(points, 0x2FFF)]
    far = points >= 0x2FFF
    if far.any():
        out[far] = _mix((points[far].astype(np.uint64) + np.uint64(1)) * np.uint64(_B))
    return out


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gear(codes: np.ndarray) -> np.ndarray:
    """Gear hash of the DEEP characters that end at each position, by doubling."""
    h, step = codes.astype(np.uint32), 1
    while step < DEEP:
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(2 * step)
        h, step = nxt, step * 2
    return h


def cuts(codes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions (of the last character of the hashed stretch) where the hash is the least of some window."""
    n = len(codes) - DEEP + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = gear(codes)[DEEP - 1 :]
    key = (h.astype(np.uint64) << np.uint64(32)) | np.arange(n, 0, -1, dtype=np.uint64)
    if n > window:
        low, step = key, 1
        while step * 2 <= window:
            low, step = np.minimum(low[:-step], low[step:]), step * 2
        rest = window - step
        if rest:
            low = np.minimum(low[: len(low) - rest], low[rest:])
    else:
        low = key.min(keepdims=True)
    at = n - (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))] + DEEP - 1


_POWER = np.cumprod(np.full(1 << 20, _B, dtype=np.uint64))
_UNDO = np.cumprod(np.full(1 << 20, pow(_B, -1, 1 << 64), dtype=np.uint64))


def chunks(text: str, least: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, digest) of the variable chunks of a text; a stretch of _CHUNK characters at a time."""
    empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(text) < least:
        return empty
    all_codes = _code(points_of(text))
    reach = least + 2 - DEEP - 2 * window
    parts, begin = [], 0
    while True:
        codes = all_codes[begin : begin + _CHUNK]
        at = cuts(codes, window)
        to = np.searchsorted(at, at + reach)
        ok = to < len(at)
        s, e = at[ok] - DEEP + 1, at[to[ok]] + 1
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * _POWER[: len(codes)])))
        d = _mix((total[e] - total[s]) * _UNDO[s] + (e - s).astype(np.uint64))
        parts.append((s + begin, e + begin, d))
        if begin + _CHUNK >= len(all_codes):
            break
        begin += _CHUNK - 2 * least  # what straddles the seam is whole in the next stretch
    return tuple(np.concatenate(x) for x in zip(*parts))


def _window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every stretch of `size` characters; texts beyond the power table are hashed in overlapping parts."""
    parts, begin, limit = [], 0, len(_POWER) - 1
    while True:
        c = codes[begin : begin + limit]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c * _POWER[: len(c)])))
        n = len(c) - size + 1
        if n > 0:
            parts.append(_mix((total[size:] - total[:-size]) * _UNDO[:n]))
        if begin + limit >= len(codes):
            return np.concatenate(parts) if parts else np.empty(0, np.uint64)
        begin += n


def shared_intervals(a: str, b: str, least: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Maximal stretches of a that consist of runs of `least` characters found in b, and the other way round."""
    if min(len(a), len(b)) < least:
        return [], []
    ha, hb = _window_hashes(_code(points_of(a)), least), _window_hashes(_code(points_of(b)), least)

    def runs(own: np.ndarray, other: np.ndarray, text: str, against: str) -> list[tuple[int, int]]:
        hit = np.flatnonzero(np.isin(own, other))
        if not len(hit):
            return []
        edge = np.flatnonzero(np.diff(hit) > least)
        starts, ends = hit[np.concatenate(([0], edge + 1))], hit[np.concatenate((edge, [len(hit) - 1]))] + least
        # A hash match is confirmed on the characters themselves.
        return [(int(s), int(e)) for s, e in zip(starts, ends) if text[s : s + least] in against]

    return runs(ha, hb, a, b), runs(hb, ha, b, a)


def _texts(docs: DataFrame, id_: str, text: str, least: int) -> DataFrame:
    rows = docs.select(F.col(id_).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull() & (F.length("text") >= least))
    return rows


def copy_classes(texts: DataFrame) -> DataFrame:
    """(doc_id, rep, members) of texts that occur more than once; rep is the least id of the class."""
    d = texts.select("doc_id", F.md5("text").alias("_md5"), F.length("text").alias("_len"))
    reps = d.groupBy("_md5", "_len").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")).filter("members > 1")
    reps = materialise(reps, "copy-classes")
    return materialise(d.join(reps, ["_md5", "_len"]).select("doc_id", "rep", "members"), "copies")


def shared_chunks(texts: DataFrame, least: int) -> DataFrame:
    """(digest, doc_id) of the chunks that more than one text holds; narrow rows, shuffled once."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, ds = [], []
            for i, t in zip(pdf["doc_id"].to_numpy(), pdf["text"]):
                d = np.unique(chunks(t, least)[2]).view(np.int64)
                ids.append(np.full(len(d), i, np.int64))
                ds.append(d)
            if ids:
                yield pd.DataFrame({"digest": np.concatenate(ds), "doc_id": np.concatenate(ids)})

    occ = materialise(texts.mapInPandas(digests, "digest bigint, doc_id bigint"), "chunks")
    # Counted map-side first, so a chunk that very many records hold weighs on no task.
    held = occ.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("digest", "n")
    return materialise(occ.join(held, "digest").select("digest", "doc_id", "n"), "shared-chunks")


def shared_runs(reps: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """(run, run2, doc_id, at): of texts that hold the given chunks (digest, doc_id), the runs of `least` characters around them that come from two texts.

    A run is known by two hashes of 64 bits with unlike bases.
    """
    mine = shared.groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))  # bounded by the text's length

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t, digests in zip(pdf["doc_id"], pdf["text"], pdf["digests"]):
                s, e, d = chunks(t, least)
                hit = np.isin(d.view(np.int64), digests)
                n = len(t) - least + 1
                # A run that is shared holds a shared chunk, so it begins in [end - least, start] of one.
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, np.clip(e[hit] - least, 0, n), 1)
                np.add.at(edge, np.clip(s[hit] + 1, 0, n), -1)
                at = np.flatnonzero(np.cumsum(edge)[:n] > 0)
                codes = _code(points_of(t))
                h, g = _window_hashes(codes, least)[at], _window_hashes(_mix(codes + np.uint64(1)), least)[at]
                out.append(pd.DataFrame({"run": h.view(np.int64), "run2": g.view(np.int64), "doc_id": i, "at": at}))
            yield pd.concat(out) if out else pd.DataFrame({"run": [], "run2": [], "doc_id": [], "at": []}).astype("int64")

    occ = materialise(reps.join(mine, "doc_id").mapInPandas(runs, "run bigint, run2 bigint, doc_id bigint, at bigint"), "runs")
    common = occ.groupBy("run", "run2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("run", "run2")
    return occ.join(common, ["run", "run2"], "left_semi")


def representatives(docs: DataFrame, id_: str, text: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(texts (doc_id, text), one of each class of copies; copies as in copy_classes)."""
    if least < DEEP + 2 * WINDOW:
        raise ValueError(f"least must be at least {DEEP + 2 * WINDOW}")
    texts = _texts(docs, id_, text, least)
    copies = copy_classes(texts)
    return texts.join(copies.filter("doc_id <> rep").select("doc_id"), "doc_id", "left_anti"), copies


def _pairs(held: DataFrame, key: str) -> DataFrame:
    a, b = held.withColumnRenamed("doc_id", "a"), held.withColumnRenamed("doc_id", "b")
    return a.join(b, key).filter("a < b").select("a", "b").distinct()


def shared_pairs(docs: DataFrame, id_: str = "doc_id", text: str = "text", least: int = 200) -> tuple[DataFrame, DataFrame]:
    """(pairs, copies): pairs (a, b, in_a, in_b) of representatives with the shared stretches of each; copies as in copy_classes.

    Every pair of different texts with a common run of `least` characters is there; copies are not expanded.
    """
    reps, copies = representatives(docs, id_, text, least)
    shared = shared_chunks(reps, least)
    few, many = shared.filter(F.col("n") <= FEW).select("digest", "doc_id"), shared.filter(F.col("n") > FEW)
    pairs = _pairs(few, "digest")
    if many.limit(1).count():
        # A chunk that many records hold pairs none of them by itself: the whole runs around it have to agree.
        runs = shared_runs(reps, many, least).withColumn("key", F.struct("run", "run2")).select("key", "doc_id").distinct()
        pairs = pairs.unionByName(_pairs(materialise(runs, "common-runs"), "key"))
    pairs = materialise(pairs.distinct(), "candidate-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    part = materialise(reps.join(wanted, "doc_id", "left_semi"), "pair-texts")
    met = pairs.join(part.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(part.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"]):
                ia, ib = shared_intervals(ta, tb, least)
                if ia:
                    out.append((a, b, [{"s": s, "e": e} for s, e in ia], [{"s": s, "e": e} for s, e in ib]))
            yield pd.DataFrame(out, columns=["a", "b", "in_a", "in_b"])

    span = "array<struct<s:bigint,e:bigint>>"
    return met.select("a", "b", "ta", "tb").mapInPandas(compare, f"a bigint, b bigint, in_a {span}, in_b {span}"), copies


def expand_copies(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_a, doc_b) over all records: pairs of representatives times their copies, and the pairs within a class.

    For a caller that wants every pair by name; the number of rows is that of the result itself.
    """
    member = copies.select(F.col("rep"), F.col("doc_id").alias("m"))
    left = pairs.select("a", "b").join(member.withColumnRenamed("m", "ma"), F.col("a") == F.col("rep"), "left").drop("rep")
    both = left.join(member.withColumnRenamed("m", "mb"), F.col("b") == F.col("rep"), "left")
    across = both.select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y")).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    within = member.withColumnRenamed("m", "doc_a").join(member.withColumnRenamed("m", "doc_b"), "rep").filter("doc_a < doc_b").select("doc_a", "doc_b")
    return across.filter("doc_a < doc_b").unionByName(within).distinct()


def shared_spans(docs: DataFrame, id_: str = "doc_id", text: str = "text", least: int = 200) -> tuple[DataFrame, DataFrame]:
    """((doc_id, start, end) of representatives: their maximal stretches of runs found in some other text; copies).

    No pairs are formed, so a passage that very many records share costs no more than its occurrences:
    of every text that holds a shared chunk, the runs of `least` characters around such chunks are
    hashed, and a run is shared if its two hashes come from two texts.
    """
    reps, copies = representatives(docs, id_, text, least)
    shared = shared_chunks(reps, least)
    found = shared_runs(reps, shared, least).select("doc_id", "at")
    order = Window.partitionBy("doc_id").orderBy("at")
    gap = F.col("at") - F.lag("at").over(order)
    marked = found.withColumn("island", F.sum(F.when(gap <= least, 0).otherwise(1)).over(order))
    spans = marked.groupBy("doc_id", "island").agg(F.min("at").alias("start"), (F.max("at") + least).alias("end"))
    return spans.select("doc_id", "start", "end"), copies


def spans_of_all(docs: DataFrame, id_: str = "doc_id", text: str = "text", least: int = 200) -> DataFrame:
    """(doc_id, class_id, start, end): the shared stretches of every record; copies share their whole text, class_id is the least id of the class."""
    texts = _texts(docs, id_, text, least)
    spans, copies = shared_spans(docs, id_, text, least)
    whole = texts.groupBy("doc_id").agg(F.max(F.length("text")).cast("bigint").alias("end"))
    same = copies.select("doc_id", F.col("rep").alias("class_id")).distinct()
    alone = spans.join(same.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    return alone.unionByName(same.join(whole, "doc_id").select("doc_id", "class_id", F.lit(0).cast("bigint").alias("start"), "end"))


def shared_extent(docs: DataFrame, id_: str = "doc_id", text: str = "text", least: int = 200) -> DataFrame:
    """(doc_id, class_id, copies, spans, shared_chars, n_chars) of every record; copies share their whole text."""
    spans, copies = shared_spans(docs, id_, text, least)
    per = spans.groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("chars")).withColumnRenamed("doc_id", "class_id")
    all_ = docs.groupBy(F.col(id_).cast("bigint").alias("doc_id")).agg(F.coalesce(F.max(F.length(text)), F.lit(0)).cast("bigint").alias("n_chars"))
    out = all_.join(copies, "doc_id", "left").withColumn("class_id", F.coalesce("rep", "doc_id")).join(per, "class_id", "left")
    whole = F.col("members") > 1
    return out.select(
        "doc_id", "class_id", F.coalesce("members", F.lit(1)).cast("bigint").alias("copies"), F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("spans"),
        F.when(whole, F.col("n_chars")).otherwise(F.coalesce("chars", F.lit(0))).cast("bigint").alias("shared_chars"), "n_chars",
    )
