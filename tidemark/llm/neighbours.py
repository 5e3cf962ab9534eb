"""The most similar vectors of every vector (problem 6).

Additive quantisation: a vector is approximated by a sum of full-dimensional codewords, one of a coarse
book and one of each of STAGES residual books, chosen by beam search; the norm of the sum and how well it
stands for the vector are stored with its code. A query's inner products with all codewords make a table,
so that a stored vector is scored by look-ups. The best-scored are reranked with the exact cosine.

Close pairs: the coarse codeword also says where a vector is filed. It lies in the cell of its nearest
codeword and in all cells whose border it is nearer to than MARGIN, however many those are, and looks into
the cell of its own nearest codeword. How many codewords there are follows the number of vectors
(CELL_ROWS). A large cell is cut into blocks of rows that all meet, block by block, so what is found doesn't
depend on a cell's size. Within a cell nothing is lost: a pair is set aside only if its scores prove that its
cosine is below the threshold (`bound`). Only codes are filed several times, whole vectors once; but where
more rows of a block are close to a query than POOL, the query meets that block's vectors instead, and the
exact cosine decides (`crowded`).

Identical directions are one class with its least keys at hand, so copies, however many, are searched
once.

The codebooks are fitted on about SAMPLE vectors a group (SAMPLE_PER_WORD for each coarse codeword, where
that is more), chosen by the hash of their key; every vector is indexed.

Defined cases: null, empty, all-zero and non-finite vectors are left out; vectors of another width form
a group of their own; ties go to the smaller key; a repeated key counts once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

SAMPLE, STAGES, WORDS, BEAM = 16_384, 16, 256, 2
#: Rows a cell should hold on average, the range of the number of coarse codewords, and the sample each needs.
CELL_ROWS, FEWEST, MOST, SAMPLE_PER_WORD = 128, 16, 16_384, 8
#: Distance to a cell's border within which a vector is filed there too. A vector of cosine 0.9 lies 0.436 away in a direction of
#: its own; of that some 0.055 goes towards any one border in 64 dimensions.
MARGIN = 0.1
#: Close rows of a query and block above which exact cosines decide which to keep (close pairs).
POOL = 256
#: Rows of a stated query that are reranked exactly, of a group of RERANKED_OF vectors; more of larger ones, by the square root.
RERANKED, RERANKED_OF = 192, 10_000
HOT, STORED_BLOCK, QUERY_BLOCK = 32_768, 32_768, 32_768
#: HOT: queries that meet a crowded block's vectors at a time.
#: Groups whose codebooks are sent to the executors together (at most some MB each), and distance (squared) within which coarse codewords share a cell.
TOGETHER, MERGED = 16, 0.1
_INDEX = "grp string, key bigint, v binary, h binary, word int, code binary, norm float, fit float, cells array<int>"


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(p @ c.T - 0.5 * (c * c).sum(1), axis=1) for p in np.array_split(x, max(1, len(x) // 4096))])
        order = np.argsort(near, kind="stable")
        held, first = np.unique(near[order], return_index=True)
        n = np.diff(np.append(first, len(x)))
        c = x[rng.choice(len(x), k)]
        c[held] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
    return c


class Quantiser:
    """A coarse codebook and residual codebooks [stage][word][dimension] with beam-search encoding."""

    def __init__(self, sample: np.ndarray, stages: int = STAGES, coarse: int = WORDS, n: int = 0, words: int = WORDS, seed: int = 7):
        rng, rest, self.books, self.n = np.random.default_rng(seed), sample.astype(np.float32).copy(), [], n
        for stage in range(stages + 1):
            fitted = rest if stage == 0 else rest[:SAMPLE]  # the sample is in no order
            c = _kmeans(fitted, coarse if stage == 0 else words, 8 if stage == 0 else 6, rng).astype(np.float32)
            self.books.append(c)
            for part in np.array_split(rest, max(1, len(rest) // 4096)):
                part -= c[np.argmax(part @ c.T - 0.5 * (c * c).sum(1), axis=1)]
        # Where rows crowd, so do coarse words: those nearer than MERGED to an earlier one (squared) share its cell.
        first, lead = self.books[0], np.zeros(len(self.books[0]), bool)
        self.half = 0.5 * (first * first).sum(1)
        self.cell_of = np.zeros(len(first), np.int64)
        for i, c in enumerate(first):
            near = np.flatnonzero(lead)
            near = near[((c - first[near]) ** 2).sum(1) <= MERGED]
            self.cell_of[i] = near[0] if len(near) else i
            lead[i] = not len(near)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(coarse words, codes n x stages, norms of the sums, cosines with the sums) by beam search on |x - sum|."""
        n = len(x)
        word = np.argmax(x @ self.books[0].T - self.half, axis=1)
        codes = np.zeros((n, 1, 0), np.uint8)
        rest = (x - self.books[0][word])[:, None, :]
        rows = np.arange(n)[:, None]
        for c in self.books[1:]:
            b = rest.shape[1]
            # What is left after a word, but for what all words leave alike.
            left = ((c * c).sum(1) - 2 * (rest.reshape(n * b, -1) @ c.T)).reshape(n, b, -1)
            left += (rest * rest).sum(2)[:, :, None]
            flat, top = left.reshape(n, -1), []
            for _ in range(min(beam, b * len(c))):  # a beam is narrow: its best one by one are had sooner than by sorting
                top.append(flat.argmin(1))
                flat[rows[:, 0], top[-1]] = np.inf
            which, best = np.divmod(np.stack(top, 1), len(c))
            codes = np.concatenate((codes[rows, which], best[:, :, None].astype(np.uint8)), axis=2)
            rest = rest[rows, which] - c[best]
        best = np.argmin((rest * rest).sum(2), axis=1)
        total = x - rest[rows[:, 0], best]
        norm = np.maximum(np.linalg.norm(total, axis=1), 1e-9)
        return word, codes[rows[:, 0], best], norm.astype(np.float32), ((x * total).sum(1) / norm).astype(np.float32)

    def cells(self, x: np.ndarray, margin: float = MARGIN) -> list[np.ndarray]:
        """Of each row the cell of its nearest coarse word, then those whose border is nearer than margin."""
        c = self.books[0]
        score = x @ c.T - self.half
        own = score.argmax(1)
        # A border is half-way between two words: the gap of their scores is the distance to it times the words' distance.
        gap = score[np.arange(len(x)), own][:, None] - score
        apart = np.maximum(self.half[own][:, None] + self.half - c[own] @ c.T, 0) * 2
        i, w = np.nonzero(gap * gap <= margin * margin * apart)
        cell, mine = self.cell_of[w], self.cell_of[own]
        other = cell != mine[i]
        row, cell = np.divmod(np.unique(i[other] * len(c) + cell[other]), len(c))
        edge = np.searchsorted(row, np.arange(1, len(x)))
        return [np.concatenate(([m], p)).astype(np.int32) for m, p in zip(mine, np.split(cell, edge))]

    def scores(self, x: np.ndarray, word: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products (stored x queries) of the sums with queries, by tables of all codewords."""
        there, at = np.unique(word, return_inverse=True)
        out = (self.books[0][there] @ x.T)[at]
        for m, c in enumerate(self.books[1:]):
            out += (c @ x.T)[codes[:, m]]
        return out


def bound(least: float, fit: np.ndarray) -> np.ndarray:
    """The least cosine that a query of cosine >= least with a vector can have with the sum that stands for it, whose cosine with the vector is fit."""
    return least * fit - np.sqrt(max(1 - least * least, 0.0)) * np.sqrt(np.maximum(1 - fit * fit, 0)) - 1e-5


def vectors_of(binary) -> np.ndarray:
    """Rows of stored numbers as they are."""
    return np.frombuffer(b"".join(binary), np.float32).reshape(len(binary), -1)


def directions(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)


def plain(rows: DataFrame, group: list[Column], key: str, vec: str) -> DataFrame:
    """(grp, key, vec) of rows with a key and a vector, which may still be no usable one; grp names table, model and width."""
    base = rows.select(F.concat_ws("|", *group, F.size(vec).cast("string")).alias("grp"), F.col(key).cast("bigint").alias("key"), F.col(vec).cast("array<float>").alias("vec"))
    return base.filter(F.col("key").isNotNull() & (F.size("vec") > 0))


def usable(vecs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the vectors whose length is finite and above 0, which those are)."""
    raw = np.stack(vecs.to_list()).astype(np.float32)
    length = np.linalg.norm(raw.astype(np.float64), axis=1)
    ok = np.isfinite(length) & (length > 0)
    return raw[ok], ok


def _sizes(vectors: DataFrame) -> dict[str, int]:
    """Rows of each group: one row per table, model and width."""
    return {r["grp"]: r["count"] for r in vectors.groupBy("grp").count().collect()}


def _coarse(n: int) -> int:
    return int(2 ** np.clip(np.round(np.log2(max(n, 1) / CELL_ROWS)), np.log2(FEWEST), np.log2(MOST)))


def _train(vectors: DataFrame, sizes: dict[str, int], stages: int) -> dict[str, Quantiser]:
    """A quantiser per group, from a sample of its vectors, those of the least key hashes."""
    scale = 1 << 40
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, int(min(1.0, max(SAMPLE, SAMPLE_PER_WORD * _coarse(n)) / n) * scale))])
    chosen = vectors.filter(F.pmod(F.xxhash64("key"), F.lit(scale)) < share[F.col("grp")]).toPandas()  # every row of a group up to SAMPLE, so only larger ones can miss some
    out = {}
    for g, p in chosen.groupby("grp"):
        p = p.iloc[np.argsort(pd.util.hash_array(p["key"].to_numpy()), kind="stable")]
        raw, ok = usable(p["vec"])
        if ok.any():
            out[g] = Quantiser(directions(raw), stages, _coarse(sizes[g]), sizes[g])
    return out


def encode(vectors: DataFrame, stages: int = STAGES) -> tuple[DataFrame, list]:
    """(index rows (grp, key, v, h, word, code, norm, fit, cells), broadcasts of the quantisers by group).

    v: the stored numbers; h: digest of the direction. One pass over the vectors for each TOGETHER groups.
    """
    sizes = _sizes(vectors)
    names, out, handles = sorted(sizes), None, []
    for at in range(0, len(names), TOGETHER):
        part = {g: sizes[g] for g in names[at : at + TOGETHER]}
        rows = vectors if len(part) == len(names) else vectors.filter(F.col("grp").isin(list(part)))
        handle = vectors.sparkSession.sparkContext.broadcast(_train(rows, part, stages))
        made = rows.mapInPandas(functools.partial(_index, handle), _INDEX)
        out = made if out is None else out.unionByName(made)
        handles.append(handle)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], _INDEX)
    return materialise(out, "index"), handles


def _index(handle, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for pdf in batches:
        out = []
        for g, part in pdf.groupby("grp", sort=False):
            book = handle.value.get(g)
            for at in range(0, len(part), 1024) if book else ():
                p = part.iloc[at : at + 1024]
                raw, ok = usable(p["vec"])
                if not ok.any():
                    continue
                x = directions(raw)
                word, codes, norm, fit = book.encode(x)
                made = {"grp": g, "key": p["key"].to_numpy()[ok], "v": [r.tobytes() for r in raw], "h": [hashlib.md5(r.tobytes()).digest() for r in x]}
                out.append(pd.DataFrame(made | {"word": word.astype(np.int32), "code": [r.tobytes() for r in codes], "norm": norm, "fit": fit, "cells": book.cells(x)}))
        yield pd.concat(out) if out else pd.DataFrame(columns=["grp", "key", "v", "h", "word", "code", "norm", "fit", "cells"])


def _book(handles: list, grp: str) -> Quantiser:
    return next(h.value[grp] for h in handles if grp in h.value)


def spread(key: str, n: Column) -> Column:
    """Block of a row."""
    return F.pmod(F.xxhash64(key), n).cast("int")


def up_to(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def candidates(filed: DataFrame, handles: list, queries: Column | None, least: float | None, pool: int = POOL) -> DataFrame:
    """(grp, q, s, est, at): pairs worth an exact comparison. filed, handles from `encode`; queries: which rows (grp, key) ask, null for all.

    With `least`, what a query keeps of a block is everything its scores can't prove to be below `least`; of more than
    `pool`, one row with s = q is all that comes, with the block packed in `at` (else -1), for `crowded` to compare exactly.
    Without `least`, its best in number as `reranked` says.
    """
    code = ["word", "code", "norm", "fit"]
    if queries is None:
        asked = filed.select("grp", F.col("key").alias("q"), "v", F.get("cells", F.lit(0)).alias("cell"))
        stored = filed.select("grp", F.explode("cells").alias("cell"), F.col("key").alias("s"), *code)
    else:
        # A stated set of queries is scored against every code, block by block: where neighbours are no nearer than
        # chance puts them, the cells that hold them are half of all.
        asked = filed.filter(queries).select("grp", F.col("key").alias("q"), "v", F.lit(0).alias("cell"))
        stored = filed.select("grp", F.lit(0).alias("cell"), F.col("key").alias("s"), *code)
    # Sizes of the cells: at most MOST rows a group. Small cells next to each other share a task's group, so that there are few of those.
    ns = stored.groupBy("grp", "cell").agg(F.count("*").alias("ns")).join(asked.groupBy("grp", "cell").agg(F.count("*").alias("nq")), ["grp", "cell"])
    so_far = F.sum("ns").over(Window.partitionBy("grp").orderBy("cell"))
    blocks = ns.select("grp", "cell", F.ceil(F.col("ns") / STORED_BLOCK).cast("int").alias("bs"), F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("bq"), F.floor(so_far / (STORED_BLOCK // 2)).cast("int").alias("rack"))
    blocks = materialise(blocks, "blocks").coalesce(1)
    left = asked.join(blocks, ["grp", "cell"]).withColumn("x", spread("q", F.col("bq"))).withColumn("y", up_to(F.col("bs"))).drop("bs", "bq")
    right = stored.join(blocks, ["grp", "cell"]).withColumn("y", spread("s", F.col("bs"))).withColumn("x", up_to(F.col("bq"))).drop("bq")

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"grp": [], "q": [], "s": []}).astype({"grp": str, "q": "int64", "s": "int64"}).assign(est=0.0, at=np.int64(-1))
        if not len(a) or not len(b):
            return none
        book, out = _book(handles, key[0]), []
        b = b.sort_values(["cell", "word"], kind="stable")
        codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
        word, norm, fit, s, cell = (b[c].to_numpy() for c in ("word", "norm", "fit", "s", "cell"))
        least_score = bound(least, fit) * norm if least is not None else None
        a = a.sort_values("cell", kind="stable")
        x, q, own = directions(vectors_of(a["v"])), a["q"].to_numpy(), a["cell"].to_numpy()
        for c in np.unique(own):
            lo, hi = np.searchsorted(cell, [c, c + 1])
            if lo == hi:
                continue
            first, last = np.searchsorted(own, [c, c + 1])
            for at in range(first, last, 256):
                end = min(at + 256, last)
                score, mine = book.scores(x[at:end], word[lo:hi], codes[lo:hi]), q[at:end]
                block = -1
                if least is not None:
                    ok = score >= least_score[lo:hi, None]
                    crowd = np.flatnonzero(ok.sum(0) > pool)
                    ok[:, crowd] = False
                    i, j = np.nonzero(ok)
                    block = (int(c) << 48) + (int(b["bs"].iloc[lo]) << 24) + int(key[3])
                else:
                    score *= (fit / norm)[lo:hi, None]
                    take, crowd = min(reranked(book.n), hi - lo), np.empty(0, np.int64)
                    i = np.argpartition(-score, take - 1, axis=0)[:take].T.ravel()
                    j = np.repeat(np.arange(end - at), take)
                good = mine[j] != s[lo + i]
                i, j = i[good], j[good]
                out.append((np.concatenate((mine[j], mine[crowd])), np.concatenate((s[lo + i], mine[crowd])), np.concatenate((score[i, j], np.zeros(len(crowd)))), np.repeat(np.array([-1, block], np.int64), (len(j), len(crowd)))))
        if not out:
            return none
        q, s, est, at = (np.concatenate(v) for v in zip(*out))
        return pd.DataFrame({"grp": key[0], "q": q, "s": s, "est": est.astype(float), "at": at})

    on = ["grp", "rack", "x", "y"]
    right = right.toDF(*right.columns)  # columns of its own, though both sides come from the same rows
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(meet, "grp string, q bigint, s bigint, est double, at bigint")


def reranked(n: int) -> int:
    """Rows of a stated query that are reranked exactly, of a group of n vectors."""
    return int(RERANKED * max(1.0, n / RERANKED_OF) ** 0.5)


def crowded(marks: DataFrame, filed: DataFrame, least: float, k: int) -> DataFrame:
    """(grp, q, s): of each marked query and block (grp, q, at) all pairs of exact cosine >= least that are among the k best of q there, or of s among the queries."""
    block = ["grp", "cell", "y"]
    part = lambda shift: F.shiftright("at", shift).bitwiseAND(F.lit((1 << 24) - 1)).cast("int")
    marks = marks.select("grp", "q", part(48).alias("cell"), part(24).alias("bs"), part(0).alias("y"))
    size = marks.groupBy(*block, "bs").agg(F.ceil(F.count("*") / HOT).cast("int").alias("bq"))
    asked = marks.join(size.drop("bs"), block).withColumn("x", spread("q", F.col("bq"))).join(filed.select("grp", F.col("key").alias("q"), "v"), ["grp", "q"]).select(*block, "x", "q", "v")
    stored = filed.select("grp", F.explode("cells").alias("cell"), F.col("key").alias("s"), "v").join(size, ["grp", "cell"]).filter(F.col("y") == spread("s", F.col("bs")))
    stored = stored.withColumn("x", up_to(F.col("bq"))).select(*block, "x", "s", "v")

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        def matrix(v: pd.Series) -> np.ndarray:
            m = vectors_of(v).astype(np.float64) if len(v) else np.empty((0, 1))
            return m / np.linalg.norm(m, axis=1, keepdims=True)

        a, b = a.sort_values("q"), b.sort_values("s")
        q, s, x, y = a["q"].to_numpy(), b["s"].to_numpy(), matrix(a["v"]), matrix(b["v"])
        qs, ss = [], []
        if len(q) and len(s):
            best, whose = np.full((k, len(s)), -2.0), np.full((k, len(s)), -1)  # of each s so far
            for at in range(0, len(q), 64):
                # Ties go to the smaller key: rows are in its order, and sorting is stable.
                cos = np.round(x[at : at + 64] @ y.T, 12)
                cos[q[at : at + 64, None] == s] = -2
                i, j = np.nonzero(cos >= least - 1e-9)
                order = np.lexsort((j, -cos[i, j], i))
                i, j = i[order], j[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                qs.append(q[at + i[first]])
                ss.append(s[j[first]])
                near = np.unique(j)
                both = np.concatenate((best[:, near], cos[:, near]))
                names = np.concatenate((whose[:, near], np.repeat(np.arange(at, at + len(cos))[:, None], len(near), 1)))
                top = np.argsort(-both, axis=0, kind="stable")[:k]
                best[:, near], whose[:, near] = np.take_along_axis(both, top, 0), np.take_along_axis(names, top, 0)
            i, j = np.nonzero(best >= least - 1e-9)
            qs.append(q[whose[i, j]])
            ss.append(s[j])
        none = np.empty(0, np.int64)
        out = pd.DataFrame({"grp": key[0], "q": np.concatenate([none, *qs]), "s": np.concatenate([none, *ss])})
        return out.drop_duplicates()

    on = [*block, "x"]
    asked = asked.toDF(*asked.columns)
    return asked.groupBy(*on).cogroup(stored.toDF(*stored.columns).groupBy(*on)).applyInPandas(meet, "grp string, q bigint, s bigint")


def rerank(pairs: DataFrame, vectors: DataFrame, stored: bool = False) -> DataFrame:
    """(grp, q, s, cos) with the exact cosine. Only vectors that are in some pair are moved. stored: the pairs already lie in a table."""
    pairs = pairs.select("grp", "q", "s") if stored else materialise(pairs.select("grp", "q", "s"), "pairs")
    wanted = materialise(pairs.select("grp", F.explode(F.array("q", "s")).alias("key")).distinct(), "wanted")
    part = materialise(vectors.select("grp", "key", "v").join(wanted, ["grp", "key"], "left_semi").dropDuplicates(["grp", "key"]), "pair-vectors")
    a, b = part.withColumnsRenamed({"key": "q", "v": "vq"}), part.withColumnsRenamed({"key": "s", "v": "vs"})
    met = pairs.join(a, ["grp", "q"]).join(b, ["grp", "s"])

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.empty(len(pdf))
            for _, where in pdf.groupby("grp", sort=False).indices.items():
                x, y = (vectors_of(pdf[c].to_numpy()[where]).astype(np.float64) for c in ("vq", "vs"))
                out[where] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            yield pdf[["grp", "q", "s"]].assign(cos=out)

    return met.select("grp", "q", "s", "vq", "vs").mapInPandas(exact, "grp string, q bigint, s bigint, cos double")


def classes(filed: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows of representatives, one a direction; classes (grp, rep, key, heads: the class's k + 1 least keys))."""
    d = filed.select("grp", "key", "h").distinct()
    size = d.groupBy("grp", "h").agg(F.min("key").alias("rep"), F.count("*").alias("n"))
    many = materialise(size.filter("n > 1"), "classes")
    member = materialise(d.join(many, ["grp", "h"]).select("grp", "rep", "key"), "members")
    # The least keys: ranked within slices of a class first, so that no slice of a large class is one task's.
    slice_ = F.pmod(F.xxhash64("key"), F.lit(64))
    part = member.withColumn("r", F.row_number().over(Window.partitionBy("grp", "rep", slice_).orderBy("key"))).filter(F.col("r") <= k + 1)
    heads = part.groupBy("grp", "rep").agg(F.slice(F.sort_array(F.collect_list("key")), 1, k + 1).alias("heads"))
    reps = filed.join(member.filter("key <> rep").select("grp", "key").distinct(), ["grp", "key"], "left_anti")
    return reps, heads.join(member, ["grp", "rep"]).select("grp", "rep", "key", "heads")


def close_pairs(vectors: DataFrame, least: float = 0.9, k: int = 10) -> DataFrame:
    """(grp, key_a, key_b, cos): pairs of cosine >= least of which one is among the k most similar of the other."""
    every, handles = encode(vectors)
    filed, members = classes(every, k)
    members = materialise(members, "class-members")
    found = candidates(filed, handles, None, least)
    pair = lambda d: d.select("grp", F.least("q", "s").alias("q"), F.greatest("q", "s").alias("s"))
    open_ = F.col("at") >= 0
    found = found.select("grp", F.least("q", "s").alias("q"), F.greatest("q", "s").alias("s"), "at")
    found = materialise(found.distinct(), "found")
    marks, found = found.filter(open_).drop("s"), found.filter(~open_).select("grp", "q", "s")
    if marks.limit(1).count():
        found = materialise(found.unionByName(pair(crowded(marks, filed, least, k + 1))).distinct(), "pairs")
    good = materialise(rerank(found, filed, True).filter(F.col("cos") >= least), "close")
    both = good.unionByName(good.select("grp", F.col("s").alias("q"), F.col("q").alias("s"), "cos"))
    # Among representatives the k + 1 nearest suffice; copies only push others out.
    near = both.withColumn("r", F.row_number().over(Window.partitionBy("grp", "q").orderBy(F.desc("cos"), "s"))).filter(F.col("r") <= k + 1).drop("r")
    heads = members.select("grp", F.col("rep").alias("s"), "heads").dropDuplicates(["grp", "s"])
    wide = near.join(heads, ["grp", "s"], "left").select("grp", "q", "cos", F.explode(F.coalesce("heads", F.array("s"))).alias("s"))
    own = members.select("grp", F.col("rep").alias("q"), "key", F.col("heads"))
    asked = wide.join(own.select("grp", "q", "key"), ["grp", "q"], "left").select("grp", F.coalesce("key", "q").alias("q"), "s", "cos")
    copies = own.select("grp", F.col("key").alias("q"), F.explode("heads").alias("s"), F.lit(1.0).alias("cos"))
    all_ = asked.unionByName(copies).filter("q <> s")
    top = all_.withColumn("r", F.row_number().over(Window.partitionBy("grp", "q").orderBy(F.desc("cos"), "s"))).filter(F.col("r") <= k)
    return top.groupBy("grp", F.least("q", "s").alias("key_a"), F.greatest("q", "s").alias("key_b")).agg(F.max("cos").alias("cos"))


def nearest(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """(grp, q, s, cos, rank): the k most similar of each row that `queries` (over grp, key) selects, among all vectors."""
    filed, handles = encode(vectors)
    filed = filed.dropDuplicates(["grp", "key"])
    scored = candidates(filed, handles, queries, None)
    # As many as of one block are kept of all of a query's blocks.
    pool = F.create_map(*[F.lit(x) for h in handles for g, b in h.value.items() for x in (g, reranked(b.n))]) if handles else F.create_map(F.lit(""), F.lit(0))
    best = Window.partitionBy("grp", "q").orderBy(F.desc("est"), "s")
    pairs = scored.groupBy("grp", "q", "s").agg(F.max("est").alias("est")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= pool[F.col("grp")]).select("grp", "q", "s")
    ranked = rerank(pairs, filed).withColumn("rank", F.row_number().over(Window.partitionBy("grp", "q").orderBy(F.desc("cos"), "s")))
    return ranked.filter(F.col("rank") <= k)


def found(chunks: DataFrame, vectors: DataFrame, least: float = 0.9, k: int = 10) -> DataFrame:
    """(tab, key_a, key_b) over chunks (key doc_id * 1000 + ordinal) and, per model, vectors (key doc_id)."""
    rows = tables(chunks, vectors)
    return close_pairs(rows, least, k).select(F.split_part("grp", F.lit("|"), F.lit(1)).alias("tab"), "key_a", "key_b").distinct()


def tables(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(grp, key, vec) of both tables."""
    c = plain(chunks.withColumn("_key", F.col("doc_id") * 1000 + F.col("ordinal")), [F.lit("chunks"), F.lit("")], "_key", "vec")
    v = plain(vectors, [F.lit("vectors"), F.coalesce("model", F.lit(""))], "doc_id", "vec")
    return c.unionByName(v)
