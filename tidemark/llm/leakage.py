"""Evaluation passages inside a training corpus (problem 9).

Verbatim passages (similarity 1): every stretch of SIZE words, of items and documents alike, gets a
SimHash fingerprint over its two-word shingles. Fingerprints are split into radius + 1 blocks: two of
them within `radius` bits agree in at least one block, so looking up each document window's blocks in
the items' blocks misses none.

Reworked passages (similarity below 1): one changed word of 13 flips more bits than any usable radius
allows, so they are found by their shingles instead. Of each item window the heaviest shingles are
indexed, as many as together weigh more than a match may miss: a document window that is similar enough
has at least one of them in its place, so none is missed.

What is found is then compared exactly, word by word, by the weight of the shingles that agree (a
shingle weighs the less the more items hold it); a similarity of 1 is a verbatim passage.

Items are a stated set; they go to the executors in slices of at most SLICE windows, one pass over the
corpus per slice, so their number is not limited. Documents are neither shuffled nor collected.

Defined cases: null texts have no words; items of fewer than SIZE words have no window and are never
reported; repeated rows give repeated findings, of which one is kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, RADIUS = 13, 1
#: Windows of items sent to the executors at a time (8 bytes each, and the words): some 60 MB at most.
SLICE = 2_000_000
_WORD = re.compile(r"[^\W_]+")
_BLOCK = 60_000
#: Pairs of windows compared at a time.
_PAIRS = 500_000


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, case folded, accents composed."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    else:
        text = text.lower()
    return _WORD.findall(text)


def _hash(word: str) -> int:
    """The same in every process, unlike Python's own."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(h: np.ndarray, size: int = SIZE) -> np.ndarray:
    """SimHash of each stretch of `size` words from their hashes, in blocks so that memory stays bounded."""
    out, n = [], len(h) - size + 1
    for at in range(0, max(n, 0), _BLOCK):
        part = h[at : min(at + _BLOCK, n) + size - 1]
        shingles = _mix(part[:-1] * np.uint64(0x9E3779B97F4A7C15) + part[1:])
        bits = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=total[1:])
        ones = total[size - 1 :] - total[: -(size - 1)]
        out.append(np.packbits(2 * ones > size - 1, axis=1).view(">u8").astype(np.uint64).ravel())
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class Index:
    """Item windows by the blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], size: int = SIZE, radius: int = RADIUS, least: float = 1.0):
        self.size, self.radius = size, radius
        self.vocabulary: dict[str, int] = {}
        ids, owner, start, flat = [], [], [], []
        for item, text in items:
            w = words(text)
            if len(w) >= size:
                start.append(len(flat) + np.arange(len(w) - size + 1))
                owner.append(np.full(len(w) - size + 1, item, np.int64))
                flat.extend(self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w)
                ids.append(item)
        self.flat = np.array(flat, np.int64)
        self.start = np.concatenate(start) if start else np.empty(0, np.int64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
        hashes = np.array([_hash(x) for x in self.vocabulary], np.uint64)
        self.hash_of = {x: int(h) for x, h in zip(self.vocabulary, hashes)}
        prints = np.concatenate([fingerprints(hashes[self.flat[s[0] : s[-1] + size]], size) for s in start]) if start else np.empty(0, np.uint64)
        self.prints = prints
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            key = (prints >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)
            order = np.argsort(key, kind="stable")
            gate = np.zeros(1 << 20, bool)
            gate[(_mix(key.copy()) & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.blocks.append((int(lo), int(hi - lo), key[order], order, gate))
        # Weight of a shingle: the fewer items hold it, the heavier.
        a, b = self.flat[:-1], self.flat[1:]
        self.weight = np.zeros(len(a))
        if len(self.start):
            at = np.unique((self.start[:, None] + np.arange(size - 1)).ravel())
            _, which, counts = np.unique(a[at] * (1 << 32) + b[at], return_inverse=True, return_counts=True)
            self.weight[at] = 1 / counts[which]
        self.least = least
        if least < 1:
            self._sign(a, b)

    def _sign(self, a: np.ndarray, b: np.ndarray) -> None:
        """Of each window its heaviest shingles, until the others weigh less than `least` of it: (shingle, window, place in it)."""
        codes, windows, places = [], [], []
        for at in range(0, len(self.start), _BLOCK):
            where = self.start[at : at + _BLOCK, None] + np.arange(self.size - 1)
            w = self.weight[where]
            order = np.argsort(-w, axis=1, kind="stable")
            total = np.cumsum(np.take_along_axis(w, order, 1), axis=1)
            # Of all before it a shingle is needed as long as a match may miss them; rounding is allowed for.
            before = np.concatenate((np.zeros((len(total), 1)), total[:, :-1]), axis=1)
            i, j = np.nonzero(before <= (1 - self.least + 1e-9) * total[:, -1:])
            place = order[i, j]
            codes.append(a[where[i, place]] * (1 << 32) + b[where[i, place]])
            windows.append(at + i)
            places.append(place)
        code, window, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (codes, windows, places))
        order = np.argsort(code, kind="stable")
        self.signs, first = np.unique(code[order], return_index=True)
        self.sign_edge = np.append(first, len(order))
        self.sign_window, self.sign_place = window[order], place[order]

    def reworked(self, ids: np.ndarray, edge: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ids, item window) of all pairs that share a signing shingle in the same place, in parts. ids: words by vocabulary, else -1; edge: where documents begin and end."""
        if not len(self.signs) or len(ids) < 2:
            return
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        code = ids[at] * (1 << 32) + ids[at + 1]
        sign = np.minimum(np.searchsorted(self.signs, code), len(self.signs) - 1)
        hit = self.signs[sign] == code
        at, sign = at[hit], sign[hit]
        n = self.sign_edge[sign + 1] - self.sign_edge[sign]
        # Cut between hits, so that a part has some _PAIRS pairs.
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // _PAIRS)) + 1
        for p, s, m in zip(np.split(at, cuts), np.split(sign, cuts), np.split(n, cuts)):
            which = np.repeat(self.sign_edge[s], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            place, window = np.repeat(p, m) - self.sign_place[which], self.sign_window[which]
            doc = np.searchsorted(edge, np.repeat(p, m), "right") - 1
            inside = (place >= edge[doc]) & (place + self.size <= edge[doc + 1])  # not across two documents
            both = np.unique(place[inside] * len(self.start) + window[inside])
            yield both // len(self.start), both % len(self.start)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, item window) of all pairs within the radius."""
        found = []
        for lo, width, keys, order, gate in self.blocks:
            key = (prints >> np.uint64(lo)) & np.uint64((1 << width) - 1)
            at = np.flatnonzero(gate[(_mix(key.copy()) & np.uint64((1 << 20) - 1)).astype(np.int64)])
            left, right = np.searchsorted(keys, key[at]), np.searchsorted(keys, key[at], "right")
            n = right - left
            place, offset = np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window = order[np.repeat(left, n) + offset]
            near = np.bitwise_count(prints[place] ^ self.prints[window]) <= self.radius
            found.append(np.stack((place[near], window[near])))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return both[0], both[1]

    def similarity(self, ids: np.ndarray, place: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Weighted share of the item window's shingles that stand at the same place in the document's window; 1 only if all words agree."""
        if not len(place):
            return np.empty(0)
        steps = np.arange(self.size)
        item = self.flat[self.start[window][:, None] + steps]
        same = ids[place[:, None] + steps] == item
        pair = same[:, :-1] & same[:, 1:]
        weight = self.weight[self.start[window][:, None] + steps[:-1]]
        share = (weight * pair).sum(1) / weight.sum(1)
        return np.where(same.all(1), 1.0, np.minimum(share, 1 - 1e-9))


def find(docs: DataFrame, items: DataFrame, similarity: float = 1.0, size: int = SIZE, radius: int = RADIUS) -> DataFrame:
    """(item_id, doc_id, windows): documents that hold windows of an item with at least this weighted-shingle similarity."""
    spark = docs.sparkSession
    rows = items.select(F.col("item_id").cast("bigint"), "text").filter("item_id is not null and text is not null")
    slices, part, count = [], [], 0
    for r in rows.toLocalIterator():
        part.append((r[0], r[1]))
        count += len(r[1]) // 2
        if count > SLICE:
            slices.append(part)
            part, count = [], 0
    slices.append(part)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    out = None
    for part in slices:
        handle = spark.sparkContext.broadcast(Index(part, size, radius, similarity))
        got = texts.mapInPandas(lambda batches, h=handle: _scan(batches, h.value, similarity), "item_id bigint, doc_id bigint, windows bigint")
        out = got if out is None else out.unionByName(got)
    return out.groupBy("item_id", "doc_id").agg(F.max("windows").alias("windows"))


def _scan(batches: Iterator[pd.DataFrame], index: Index, similarity: float) -> Iterator[pd.DataFrame]:
    cache: dict[str, int] = {}
    size = index.size
    for pdf in batches:
        owner, flat, hashes = [], [], []
        for doc, text in zip(pdf["doc_id"].to_numpy(), pdf["text"]):
            w = words(text)
            if len(w) < size:
                continue
            flat.append(w)
            owner.append(doc)
            if similarity < 1:
                continue
            for x in w:
                if x not in cache:
                    cache[x] = index.hash_of[x] if x in index.hash_of else _hash(x)
            hashes.append(np.fromiter((cache[x] for x in w), np.uint64, len(w)))
            if len(cache) > 500_000:
                cache.clear()
        found = []
        if owner:
            edge = np.cumsum([0] + [len(x) for x in flat])
            if similarity < 1:
                ids = np.fromiter((index.vocabulary.get(x, -1) for w in flat for x in w), np.int64, edge[-1])
                parts = index.reworked(ids, edge)
            else:
                h = np.concatenate(hashes)
                place, window = index.candidates(fingerprints(h, size))
                which = np.searchsorted(edge, place, "right") - 1
                inside = place + size <= edge[which + 1]  # not across two documents
                place, window = place[inside], window[inside]
                ids = np.full(len(h), -1, np.int64)
                near = np.unique((place[:, None] + np.arange(size)).ravel())
                whose = np.searchsorted(edge, near, "right") - 1
                ids[near] = [index.vocabulary.get(flat[k][i - edge[k]], -1) for i, k in zip(near.tolist(), whose.tolist())]
                parts = [(place, window)]
            for place, window in parts:
                ok = index.similarity(ids, place, window) >= similarity
                which = np.searchsorted(edge, place[ok], "right") - 1
                found.append(pd.DataFrame({"item_id": index.owner[window[ok]], "doc_id": np.array(owner, np.int64)[which], "place": place[ok]}))
        if found:
            got = pd.concat(found).drop_duplicates()
            yield got.groupby(["item_id", "doc_id"], as_index=False).agg(windows=("place", "size"))
        else:
            yield pd.DataFrame({"item_id": [], "doc_id": [], "windows": []}).astype("int64")
