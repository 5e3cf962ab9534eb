"""Filling containers of fixed capacity with texts measured in tokens (problem 8).

Conflict-constrained best fit, largest first: open bins are kept in order of the room left, each with a
bitmap of the sources that may not enter it again and one of the duplicate clusters it holds. An item
goes to the first bin from its own size upward whose bitmaps allow it: the tightest compatible one.

A duplicate cluster is the set of texts with the same words, whatever their case, spacing and
punctuation; two of one cluster never share a bin. A source may enter a bin `quota` times: SLACK
times its share of all tokens, counted in items, but at least once.

Items are dealt to shards of SHARD items by the hash of their id, so sizes and sources are mixed alike
in all; each shard packs on its own, which costs at most its last, half-full bins.

A text above the capacity is cut at token positions into full containers and a rest, which is packed
like any other item.

Defined cases: null texts have no item; empty texts are items of no tokens; repeated ids are items of
their own; a null source conflicts with nothing.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.leakage import words
from tidemark.session import materialise

CAPACITY, SHARD = 2048, 8192
#: How many times its even share of a container a source may take before it is shut out. At sf0.1 the containers
#: are 95 % full with 1 (at most once each), 98.8 % with 4, 99.8 % with 8.
SLACK = 8
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str = TOKENIZER):
    """A byte-level tokenizer from its rank file, read where it is used."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def measure(docs: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, cluster): size and duplicate cluster of each text; one narrow row a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for pdf in batches:
            tokens = [len(enc.encode_ordinary(t)) for t in pdf["text"]]
            cluster = [int.from_bytes(hashlib.blake2b(" ".join(words(t)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in pdf["text"]]
            yield pdf[["doc_id", "source"]].assign(tokens=tokens, cluster=cluster)

    rows = docs.select(F.col(id_).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, tokens bigint, cluster bigint")


def best_fit(sizes: list[int], sources: list, clusters: list, quotas: list[int], capacity: int) -> list[int]:
    """Bin of each item (sizes at most the capacity), largest first; see the module's text."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << k for k, c in enumerate(dict.fromkeys(clusters))}
    rooms: list[tuple[int, int]] = []
    shut, holds, inside, out = [], [], [], [0] * len(sizes)
    for i in order:
        s, c = source_bit.get(sources[i], 0), cluster_bit[clusters[i]]
        at = bisect_left(rooms, (sizes[i], -1))
        while at < len(rooms) and (shut[rooms[at][1]] & s or holds[rooms[at][1]] & c):
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(shut)
            shut.append(0)
            holds.append(0)
            inside.append({})
        out[i] = b
        holds[b] |= c
        if s:
            inside[b][s] = inside[b].get(s, 0) + 1
            if inside[b][s] >= quotas[i]:
                shut[b] |= s
        insort(rooms, (room - sizes[i], b))
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(container_id, doc_id, part, first_token, tokens) from (doc_id, source, tokens, cluster)."""
    items = materialise(items, "items")
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    shards = max(1, -(-total["n"] // shard))
    per_bin = capacity * max(total["n"], 1) / max(total["t"], 1)
    # Sources whose share calls for a quota above one: fewer than SLACK * per_bin of them can exist.
    share = F.sum("tokens") / F.lit(float(max(total["t"], 1)))
    large = items.filter("source is not null").groupBy("source").agg(F.ceil(share * SLACK * per_bin).cast("int").alias("quota")).filter("quota > 1")
    rows = items.join(large, "source", "left").withColumn("quota", F.coalesce("quota", F.lit(1)))
    # Pieces of the capacity stand alone; the rest of a long text is an item.
    whole = F.floor(F.col("tokens") / capacity)
    full = rows.filter(F.col("tokens") > capacity).select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("part"))
    full = full.select(
        F.concat_ws("-", F.lit("whole"), F.col("doc_id").cast("string"), F.col("part").cast("string")).alias("container_id"),
        "doc_id", "part", (F.col("part") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("tokens"),
    )
    over = F.col("tokens") > capacity
    rest = rows.select(
        "doc_id", "source", "cluster", "quota", F.when(over, whole).otherwise(0).cast("bigint").alias("part"), F.when(over, F.col("tokens") % capacity).otherwise(F.col("tokens")).alias("tokens"), over.alias("over")
    ).filter(~(F.col("over") & (F.col("tokens") == 0)))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)).cast("int"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part", "tokens"], kind="stable")
        sources = [None if s is None or s != s else s for s in pdf["source"]]
        bins = best_fit(pdf["tokens"].tolist(), sources, pdf["cluster"].tolist(), pdf["quota"].tolist(), capacity)
        return pdf[["doc_id", "part", "tokens"]].assign(container_id=[f"{key[0]}-{b}" for b in bins], first_token=pdf["part"] * capacity)[["container_id", "doc_id", "part", "first_token", "tokens"]]

    packed = rest.groupBy("shard").applyInPandas(run, "container_id string, doc_id bigint, part bigint, first_token bigint, tokens bigint")
    return packed.unionByName(full)


def containers(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    return pack(measure(docs, tokenizer=tokenizer), capacity)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, room, fill) over all containers."""
    per = packed.groupBy("container_id").agg(F.sum("tokens").alias("t"))
    return per.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum(capacity - F.col("t")).alias("room"), F.round(F.sum("t") / (F.count("*") * capacity), 4).alias("fill"))
