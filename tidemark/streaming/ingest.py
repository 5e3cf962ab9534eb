"""Streams: exactly-once ingestion and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lifecycle import first_of_each
from tidemark.session import shared_dir


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run a stream over what is there and give its result: an exactly-once file sink in the shared folder."""
    spark = stream.sparkSession
    out, checkpoint = out or shared_dir(spark, "stream-out"), checkpoint or shared_dir(spark, "stream-state")
    if mode != "append":
        raise ValueError("a file sink only appends")
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def files(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A test table as a stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def once_per_key(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Rows whose key was not seen within the delay; state is dropped behind the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, at: str, width: str, delay: str, *keys: str) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, delay: str, key: str) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def ingest(lines: DataFrame, adapter: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, max_rows: int | None = None) -> None:
    """Append the rows of a stream of lines to a table, each sha once.

    A batch is written under its own number, over whatever a failed attempt at it left, and offsets are
    committed after it: rows and checkpoint can't drift apart, and a batch that is run again writes the
    same rows. Shas are held against all earlier batches.
    """
    spark = lines.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        rows = adapter(batch)
        # Of equal shas always the same row stays, so a batch that is run again writes what it wrote before.
        rows = first_of_each(rows, "sha", [c for c in ("path", "src_offset", "line_no", *sorted(rows.columns)) if c in rows.columns])
        done = earlier(spark, table, number)
        if done is not None:
            rows = rows.join(done.select("sha"), "sha", "left_anti")
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def earlier(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The table's batches below a number, or all."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    numbers = sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("batch="))
    keep = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(*[f"{table}/batch={n}" for n in keep]) if keep else None
