"""Structured Streaming entry points: the same plane maps over a stream, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refold.operators.clips import PLANE, Clip
from refold.operators.resample import inverse_resample


def frames(spark: SparkSession, path: str, width: int, height: int, files_per_trigger: int = 1, **clip) -> Clip:
    """A live clip: plane rows from Parquet files as they arrive."""
    rows = spark.readStream.schema(PLANE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return Clip(rows, width, height, **clip)


def inverse_stream(clip: Clip, width: int, height: int, **args) -> DataFrame:
    """The inverse as a stateless map; the plan is made once, before the stream starts."""
    return inverse_resample(clip, width, height, **args).rows


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Event times as instants: watermarks need TIMESTAMP, tables may hold TIMESTAMP_NTZ."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(events: DataFrame, ts: str, size: str, slide: str | None = None, late: str | None = None, *keys: str) -> DataFrame:
    """Rows and total value in tumbling windows, or sliding ones. late: how long a stream waits."""
    timed = _timed(events, ts)
    if late:
        timed = timed.withWatermark(ts, late)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return timed.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def session_counts(events: DataFrame, ts: str, gap: str, late: str | None = None, *keys: str) -> DataFrame:
    """Rows in sessions that a gap ends."""
    timed = _timed(events, ts)
    if late:
        timed = timed.withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def deduplicated(events: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return _timed(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
