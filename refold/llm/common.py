"""Shared plumbing: input selection, scratch tables in the shared folder, partition counts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words, as a regex class body.
SPACE = r" \t-\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none is a local folder taken (single-machine runs and tests).
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="refold-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/") if "://" in named or named.startswith("file:") else "file://" + named.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared one, removed when the application ends."""
    path = f"{shared_dir(spark)}/refold-{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settle(df: DataFrame, tag: str, keep_schema: bool = True) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, executors may go."""
    spark = df.sparkSession
    path = f"{scratch(spark, tag)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if keep_schema else spark.read.parquet(path)


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Arrow batches of `limit` bytes at most, so that a worker holds little of long texts at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > limit:
        spark.conf.set(name, str(limit))


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate; for file scans the bytes on disk."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Partitions for a shuffle of df: by its size, and never under the session's own number."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, -(-size_in_bytes(df) // bytes_each)))


def words_of(text):
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text column; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")
