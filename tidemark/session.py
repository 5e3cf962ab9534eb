"""Session building and the one place that knows where shared intermediate files go."""

from __future__ import annotations

import io
import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "tidemark", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.legacy.parquet.nanosAsLong": "false",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder name under spark.checkpoint.dir, which every executor can reach.

    Only where that setting is absent on a single machine (tests) a temporary folder is set for it; a cluster without it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") and not os.environ.get("TIDEMARK_SHARED"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.environ.get("TIDEMARK_SHARED") or tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


#: Tables that `materialise` wrote in this process.
_MADE: list[str] = []


def sweep(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process; to be called when no result that reads them is needed any more. Returns their number."""
    n = len(_MADE)
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def ship(spark: SparkSession) -> None:
    """Make the package importable in every Python worker, wherever the driver was started; once per session."""
    done = "tidemark.shipped"
    if spark.conf.get(done, None):
        return
    root, buffer = pathlib.Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark, "code") + "/tidemark.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path.toString())
    spark.conf.set(done, "true")


def materialise(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder; a lost executor costs a re-read, not a re-run."""
    spark = df.sparkSession
    ship(spark)
    path = shared_dir(spark, what)
    _MADE.append(path)
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
