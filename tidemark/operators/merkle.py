"""Only new or changed records, by comparing hash trees over key ranges (problem 5).

A tree's leaf covers a range of the hashed key space and holds an order-free digest of its rows (count,
sum and exclusive-or of two row hashes); a node's digest is the hash of its children's. The number of
leaves follows that of the rows (`bits_for`), so that a leaf stays a few hundred rows. `changed_leaves`
walks two trees from the root and descends only where digests differ; `extract` reads the rows of the
leaves that remain. `IncrementalRun` writes a run's output, rows and tree into a folder of its own and makes
them current by one rename of a pointer file that names it: a run that dies before has no effect, one that dies after
is not repeated, and of two runs at once the later one fails without touching what the other has published.

Defined cases: nulls hash like a value of their own; repeated rows change a digest; an empty side
differs from every non-empty leaf of the other; key and value columns are named by the caller, others
are ignored for digests and passed through by `extract`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise

FAN_BITS = 4
#: Rows a leaf should hold, and the least and greatest number of leaves, as bits: 16 and 16**7.
LEAF_ROWS, FEWEST_BITS, MOST_BITS = 256, 4, 28
#: Leaves up to which the levels above are folded by one task.
ONE_TASK_BITS = 16
LEAF_BITS = 16


def bits_for(rows: int) -> int:
    """Depth, in bits, of a tree over so many rows."""
    bits = FEWEST_BITS
    while bits < MOST_BITS and rows >> bits > LEAF_ROWS:
        bits += FAN_BITS
    return bits


def leaf_of(key: Column, bits: int = LEAF_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def tree(rows: DataFrame, key: Column, values: list[Column], bits: int = LEAF_BITS) -> DataFrame:
    """(level, node, digest); level 0 is the root, the last level the leaves. Row hashes are summed map-side."""
    h = F.xxhash64(*values)
    leaves = rows.select(leaf_of(key, bits).alias("node"), h.alias("h"), F.xxhash64(F.lit(7), *values).alias("g")).groupBy("node").agg(
        F.sha2(F.concat_ws(",", F.count("*").cast("string"), F.sum(F.col("h").cast("decimal(20,0)")).cast("string"), F.bit_xor("g").cast("string")), 256).alias("digest")
    )
    # Written once; the levels above a tree of some 65,000 leaves are folded by one task without a shuffle, those of a larger one by many.
    leaves = materialise(leaves, "leaves")
    leaves = leaves.coalesce(1) if bits <= ONE_TASK_BITS else leaves
    levels, level = [leaves.withColumn("level", F.lit(bits // FAN_BITS))], leaves
    for n in range(bits // FAN_BITS - 1, -1, -1):
        level = level.groupBy(F.shiftrightunsigned("node", FAN_BITS).alias("node")).agg(
            F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("node", "digest")))), 256).alias("digest")
        )
        levels.append(level.withColumn("level", F.lit(n)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    out = out.select("level", "node", "digest")
    return materialise(out.coalesce(1) if bits <= ONE_TASK_BITS else out, "tree")


def changed_leaves(current: DataFrame, saved: DataFrame, bits: int = LEAF_BITS) -> DataFrame:
    """(node) of the leaves that differ, reached only through differing parents."""
    at = lambda t, n: t.filter(F.col("level") == n).select("node", "digest")
    reached = None
    if bits <= ONE_TASK_BITS:
        current, saved = current.coalesce(1), saved.coalesce(1)
    for n in range(bits // FAN_BITS + 1):
        differ = at(current, n).join(at(saved, n).withColumnRenamed("digest", "was"), "node", "full").filter(~F.col("digest").eqNullSafe(F.col("was"))).select("node")
        if reached is not None:
            differ = differ.join(reached.withColumnRenamed("node", "up"), F.shiftrightunsigned("node", FAN_BITS) == F.col("up"), "left_semi")
        reached = differ
    return reached


def extract(rows: DataFrame, key: Column, leaves: DataFrame, bits: int = LEAF_BITS) -> DataFrame:
    """The rows of the given leaves. There are at most 2**bits leaves, so the join's small side is bounded."""
    return rows.withColumn("_leaf", leaf_of(key, bits)).join(leaves.withColumnRenamed("node", "_leaf"), "_leaf", "left_semi").drop("_leaf")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def listing(files: DataFrame) -> DataFrame:
    """The newest row of each path (ties: the larger size, then sha)."""
    newest = files.groupBy("path").agg(F.max(F.struct("listed_at", "size", "sha")).alias("f"))
    return newest.select("path", "f.size", "f.sha", base_name(F.col("path")).alias("base"))


def checkpoints(sources: DataFrame) -> DataFrame:
    """(path, sha, durable, base, at): bytes known to be stored. A failed run without a count has stored none for sure."""
    run = F.get_json_object("state", "$.run")
    committed = F.coalesce(F.get_json_object("state", "$.committed").try_cast("bigint"), F.lit(0))
    durable = F.when(run.isNotNull() & (run != "ok"), committed).otherwise(F.col("offset"))
    return sources.select("path", "sha", durable.alias("durable"), base_name(F.col("path")).alias("base"), F.col("ingested_at").alias("at"))


def stored_tree(saved: DataFrame, bits: int) -> DataFrame:
    """The tree of what is stored of each file, as `pending_files` compares it."""
    return tree(saved, F.col("base"), [F.col("path"), F.col("sha"), F.col("durable").cast("bigint")], bits)


def pending_files(files: DataFrame, sources: DataFrame, bits: int | None = None, published: DataFrame | None = None) -> DataFrame:
    """(path, from_offset, size) of listed files that have bytes to read.

    published: the `stored_tree` that the last run wrote with its checkpoints, of the same bits; built from the checkpoints where there is none.

    Both sides become trees keyed by base name, so that a moved file falls into the leaf of its old
    record. A file whose listing equals its checkpoint adds the same hash to both sides; only leaves
    that differ are read row by row.
    """
    now, saved = materialise(listing(files), "listing"), checkpoints(sources)
    bits = bits or bits_for(now.count())
    mine = tree(now, F.col("base"), [F.col("path"), F.col("sha"), F.col("size").cast("bigint")], bits)
    theirs = stored_tree(saved, bits) if published is None else published
    leaves = materialise(changed_leaves(mine, theirs, bits), "changed")
    files_, marks = extract(now, F.col("base"), leaves, bits), extract(saved, F.col("base"), leaves, bits)
    moved = (
        marks.join(now.select("path"), "path", "left_anti").groupBy("base")
        .agg(F.max(F.struct("at", "path", "sha", "durable")).alias("m")).select("base", F.col("m.sha").alias("m_sha"), F.col("m.durable").alias("m_durable"))
    )
    own = marks.select("path", F.col("sha").alias("c_sha"), F.col("durable").alias("c_durable"), F.lit(True).alias("own"))
    met = files_.join(own, "path", "left").join(moved, "base", "left")
    sha = F.when(F.col("own"), F.col("c_sha")).otherwise(F.col("m_sha"))
    durable = F.when(F.col("own"), F.col("c_durable")).otherwise(F.col("m_durable"))
    start = F.when(durable.isNull() | ~F.coalesce(sha == F.col("sha"), F.lit(False)) | (F.col("size") < durable), 0).otherwise(durable)
    return met.select("path", start.cast("bigint").alias("from_offset"), "size").filter("from_offset < size")


class IncrementalRun:
    """Runs over a keyed table that hand only new or changed rows to `process`, exactly once.

    state_dir must be on storage all executors share. Layout: a folder run-<id> per run with rows (key, digest), tree,
    output and deleted (keys that the table no longer has), and a pointer file CURRENT.<N> per published version that
    holds the folder's name; the highest is in force. bits: depth of the tree; follows the first run's rows if not stated.
    """

    def __init__(self, spark: SparkSession, state_dir: str, key: str, values: list[str], bits: int | None = None):
        self.spark, self.dir, self.key, self.values, self.bits = spark, state_dir.rstrip("/"), key, values, bits
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.dir).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The highest published version; pointer files are never overwritten, so there is no moment without one."""
        at = self._path(self.dir)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n[8:]) for n in names if n.startswith("CURRENT.")), default=0)

    def _folder(self, version: int) -> str:
        name, at = self.spark.read.text(f"{self.dir}/CURRENT.{version}").first()[0], self.dir
        return f"{at}/{name}"

    def output(self) -> DataFrame | None:
        """All rows processed so far, over all published versions."""
        n = self.version()
        return self.spark.read.parquet(*[f"{self._folder(i)}/output" for i in range(1, n + 1)]) if n else None

    def deleted(self) -> DataFrame | None:
        """Keys that the last published run no longer found."""
        n = self.version()
        return self.spark.read.parquet(f"{self._folder(n)}/deleted") if n else None

    def run(self, rows: DataFrame, process: Callable[[DataFrame], DataFrame], before_publish: Callable[[], None] = lambda: None) -> int:
        """Process what changed since the published version and publish the next; returns its number."""
        old = self.version()
        name = f"run-{uuid.uuid4().hex}"
        at, read = f"{self.dir}/{name}", self.spark.read.parquet
        key, values = F.col(self.key), [F.col(self.key), *[F.col(v) for v in self.values]]
        rows.select(key, F.xxhash64(*values).alias("_row")).write.parquet(f"{at}/rows")
        digests = read(f"{at}/rows")
        # Both trees are over the written digests, so a tree of another depth can be made of the saved ones alone.
        bits = self.bits or bits_for(digests.count())
        tree(digests, key, [F.col("_row")], bits).withColumn("bits", F.lit(bits)).write.parquet(f"{at}/tree")
        mine = read(f"{at}/tree")
        if old:
            before = self._folder(old)
            was, saved = read(f"{before}/rows"), read(f"{before}/tree")
            if saved.first()["bits"] != bits:
                saved = tree(was, key, [F.col("_row")], bits)
            leaves = changed_leaves(mine, saved, bits)
            was = extract(was, key, leaves, bits)
            part = extract(rows, key, leaves, bits).withColumn("_row", F.xxhash64(*values))
            same = part[self.key].eqNullSafe(was[self.key]) & (part["_row"] == was["_row"])
            changed = part.join(was, same, "left_anti").drop("_row")
            there = extract(digests, key, leaves, bits)
            gone = was.join(there, was[self.key].eqNullSafe(there[self.key]), "left_anti").select(self.key).distinct()
        else:
            changed, gone = rows, digests.select(self.key).limit(0)
        process(changed).write.parquet(f"{at}/output")
        gone.write.parquet(f"{at}/deleted")
        before_publish()
        tmp, pointer = self._path(f"{at}/_pointer"), self._path(f"{self.dir}/CURRENT.{old + 1}")
        out = self._fs.create(tmp, False)
        out.write(bytearray(name.encode()))
        out.close()
        # Where renaming onto a file is refused (as in HDFS) this decides between two runs; elsewhere the check before it does, nearly.
        if self._fs.exists(pointer) or not self._fs.rename(tmp, pointer):
            raise RuntimeError("another run published this version")
        return old + 1
