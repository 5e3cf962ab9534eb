"""Splitting oversized texts at natural boundaries (problem 3).

A text is parsed into a tree: sections by their headings, a deeper heading within the shallower one before it;
in them blocks between blank lines, list items by their indentation, and fences, which hold together; in those
lines, and words. What the tree is asked for is where siblings meet and how high up (`Tree`). Siblings are merged
bottom-up: a piece takes words, then whole lines, blocks and sections for as long as it stays within the limit,
and ends where the highest siblings meet that it can reach; lines are looked into for words only where nothing
higher is in reach. The next piece begins `overlap` characters before the cut.

`audit` holds stored pieces against the same tree.

Defined cases: null and empty texts give no piece from `split` (there is nothing to cut); texts within
the limit give one piece; text without any boundary is cut at the limit; a carriage return is a character like
others, so lines that end in CRLF have line ends but no blank lines; positions are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, EARLIEST = 2048, 256, 1500
#: Sorts of boundary, best first: a blank line, the end of a line, white space, none.
BLANK, LINE, SPACE, NONE = 1, 2, 3, 4
_HEADING = re.compile(r"(#{1,6})[ \t]")
_ITEM = re.compile(r"([ \t]*)(?:[-*+]|\d+[.)])[ \t]")
_MARKUP = re.compile(r"</?\w")
_FENCE = re.compile(r" {0,3}(```|~~~)")
#: Depths below the six of headings: a block, an item of a list (by indentation), a line, and any of them within a fence.
_BLOCK, _LIST, _PLAIN, _FENCED = 7, 8, 14, 15


class Tree:
    """Where siblings of a text's structure tree meet: ends[k], with sort and depth of the siblings; the shallower the higher up."""

    def __init__(self, text: str):
        self.text, self.ends, self.ranks = text, [], []
        at, fenced, n = 0, bool(_FENCE.match(text)), len(text)
        while at < n:
            at = text.find("\n", at) + 1
            if not at:
                break
            # What follows begins a new node; how high up it hangs says its first line.
            sort = BLANK if at > 1 and text[at - 2] == "\n" else LINE
            fence = at < n and text[at] in " `~" and _FENCE.match(text, at)
            self.ends.append(at)
            self.ranks.append((sort, _FENCED if fenced else self._depth(at, sort)))
            if fence:
                fenced = not fenced

    def _depth(self, at: int, sort: int) -> int:
        c = self.text[at : at + 1] or "\n"
        heading = _HEADING.match(self.text, at) if c == "#" else None
        if heading:
            return len(heading[1])
        item = _ITEM.match(self.text, at) if c in " \t-*+0123456789" else None
        if item:
            return _LIST + min(len(item[1].expandtabs(4)) // 2, 5)
        return _BLOCK if sort == BLANK or c == "<" and _MARKUP.match(self.text, at) else _PLAIN

    def meets(self, after: int, until: int) -> tuple[int, int]:
        """(sort, place) of the highest siblings that meet in (after, until], the last of them; (NONE, until) where none do."""
        lo, hi = bisect_right(self.ends, after), bisect_right(self.ends, until)
        if lo < hi:
            best = min(self.ranks[lo:hi])
            return best[0], max(e for e, r in zip(self.ends[lo:hi], self.ranks[lo:hi]) if r == best)
        at = max(self.text.rfind(" ", after, until), self.text.rfind("\t", after, until))
        return (SPACE, at + 1) if at >= 0 else (NONE, until)

    def sort_at(self, place: int) -> int:
        """Sort of the boundary at a place."""
        k = bisect_right(self.ends, place) - 1
        if k >= 0 and self.ends[k] == place:
            return self.ranks[k][0]
        tail = self.text[max(0, place - 2) : place]
        return BLANK if tail == "\n\n" else LINE if tail.endswith("\n") else SPACE if tail.endswith((" ", "\t")) else NONE


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, earliest: int = EARLIEST) -> list[tuple[int, int]]:
    out, start, n, tree = [], 0, len(text), Tree(text)
    while n - start > limit:
        end = tree.meets(start + earliest, start + limit)[1]
        out.append((start, end))
        start = end - overlap
    if n:
        out.append((start, n))
    return out


def split(docs: DataFrame, id_: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, earliest: int = EARLIEST, with_text: bool = False) -> DataFrame:
    """(id, ordinal, start_offset, end_offset[, piece]) of every text; no shuffle, each text on its own."""
    if not 0 <= overlap < earliest < limit:
        raise ValueError("needs 0 <= overlap < earliest < limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, k, s, e, *([t[s:e]] if with_text else [])) for i, t in zip(pdf["id"], pdf["text"]) if t for k, (s, e) in enumerate(pieces(t, limit, overlap, earliest))]
            yield pd.DataFrame(out, columns=["id", "ordinal", "start_offset", "end_offset", *(["piece"] if with_text else [])])

    rows = docs.select(F.col(id_).cast("bigint").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    short = F.length("text") <= limit
    one = rows.filter(short & (F.length("text") > 0)).select(
        "id", F.lit(0).cast("bigint").alias("ordinal"), F.lit(0).cast("bigint").alias("start_offset"), F.length("text").cast("bigint").alias("end_offset"), *([F.col("text").alias("piece")] if with_text else [])
    )
    many = rows.filter(~short).mapInPandas(run, "id bigint, ordinal bigint, start_offset bigint, end_offset bigint" + (", piece string" if with_text else ""))
    return one.unionByName(many).withColumnRenamed("id", id_)


def _sorts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the best sort in the window and the sort of the stored cut, by the tree of the text around them."""
    for pdf in batches:
        # The windows begin one character before the first place to cut; what the tree sees first is only there to tell a blank line.
        level = [Tree(w).meets(1, len(w))[0] if isinstance(w, str) and len(w) > 1 else NONE for w in pdf["w"]]
        own = [Tree(t).sort_at(len(t)) if isinstance(t, str) and t else NONE for t in pdf["tail"]]
        yield pdf.drop(columns=["w", "tail"]).assign(level=level, own=own)


def audit(chunks: DataFrame, docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, earliest: int = EARLIEST) -> DataFrame:
    """(doc_id, ordinal) of stored pieces that break the cut, and (doc_id, -1) of oversized texts without any.

    The predecessor and the last ordinal come by joins on (project, doc_id, ordinal) and by a pre-aggregated
    maximum; texts are met once per piece and reduced to the few hundred characters around the cut.
    """
    c = chunks.select("project", "doc_id", "ordinal", F.col("start_offset").alias("s"), F.col("end_offset").alias("e"))
    before = c.select(F.col("project").alias("pp"), F.col("doc_id").alias("pd"), (F.col("ordinal") + 1).alias("po"), F.col("e").alias("pe"))
    last = c.groupBy("doc_id").agg(F.max("ordinal").alias("last"))
    c = c.join(before, F.col("project").eqNullSafe(F.col("pp")) & (F.col("doc_id") == F.col("pd")) & (F.col("ordinal") == F.col("po")), "left").drop("pp", "pd", "po")
    c = c.join(last, "doc_id", "left")
    bodies = docs.select(F.col("id").alias("doc_id"), F.coalesce("body", F.lit("")).alias("body"))
    w0 = F.col("s") + earliest  # 0-based place of the character before the first place to cut
    met = c.join(bodies, "doc_id", "left").select(
        "doc_id", "ordinal", "s", "e", "pe", "last", F.coalesce(F.length("body"), F.lit(0)).cast("bigint").alias("n"),
        F.when(F.col("s") >= 0, F.col("body").substr(w0.cast("int"), F.lit(limit - earliest + 1))).alias("w"),
        F.when(F.col("e") >= 2, F.col("body").substr((F.col("e") - 1).cast("int"), F.lit(2))).alias("tail"),
    )
    kept = ", ".join(f"{x} bigint" for x in ("doc_id", "ordinal", "s", "e", "pe", "last", "n"))
    met = met.mapInPandas(_sorts, kept + ", level int, own int")
    level, own = F.col("level"), F.col("own")
    in_reach = (F.col("e") > F.col("s") + earliest) & (F.col("e") <= F.col("s") + limit)
    is_last = F.col("ordinal") == F.col("last")
    bad = (
        F.col("s").isNull() | F.col("e").isNull() | (F.col("e") <= F.col("s")) | (F.col("e") - F.col("s") > limit) | (F.col("s") < 0) | (F.col("e") > F.col("n"))
        | F.when(F.col("ordinal") == 0, F.col("s") != 0).otherwise(F.col("pe").isNull() | (F.col("s") != F.col("pe") - overlap))
        | F.when(is_last, F.col("e") != F.col("n")).otherwise((level < NONE) & (~in_reach | (own > level)))
    )
    faulty = met.filter(F.coalesce(bad, F.lit(True))).select("doc_id", "ordinal")
    missing = docs.filter(F.length("body") > limit).select(F.col("id").alias("doc_id")).join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")
    return faulty.unionByName(missing.select("doc_id", F.lit(-1).cast("bigint").alias("ordinal"))).distinct()
