"""Intervals with whole-number times: unions, concurrency, windows, begin and end events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """Maximal runs of intervals that overlap or touch: keys, start, end, n."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) > before).cast("int"), F.lit(1))
    marked = rows.where(F.col(end) > F.col(start)).withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def union_length(rows: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """Time covered by at least one interval."""
    return islands(rows, start, end, *keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count(F.lit(1)).alias("n_islands"))


def peak_concurrency(rows: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """Most intervals at one time; an interval that ends as another begins doesn't meet it."""
    marks = rows.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("m")).select(*keys, "m.t", "m.d")
    # equal marks are added up first, so a busy instant is one row
    summed = marks.groupBy(*keys, "t", "d").agg(F.sum("d").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*keys).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0))
    return summed.withColumn("level", running).groupBy(*keys).agg(F.max("level").alias("peak"))


def clipped(rows: DataFrame, start: str, end: str, first, last) -> DataFrame:
    """Intervals cut to [first, last); those outside go."""
    low, high = F.lit(first), F.lit(last)
    met = rows.where((F.col(start) < high) & (F.col(end) > low))
    return met.withColumns({start: F.greatest(F.col(start), low), end: F.least(F.col(end), high)})


def matched(events: DataFrame, ident: str, kind: str, when: str, begin: str, end: str) -> DataFrame:
    """Intervals from events: the first begin and the last end of each id, if the end is later."""
    at = lambda k, f: f(F.when(F.col(kind) == k, F.col(when)))
    both = events.where(F.col(kind).isin(begin, end)).groupBy(ident).agg(at(begin, F.min).alias("start"), at(end, F.max).alias("end"))
    return both.where(F.col("end") > F.col("start"))


def measured(rows: DataFrame, order: str, skip: int, take: int, *keys: str) -> DataFrame:
    """Rows skip + 1..skip + take of each key: warm-ups are left out."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("n", n).where(F.col("n").between(skip + 1, skip + take)).drop("n")


def gaps(rows: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """Batches that don't begin where the one before ended."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(start))
    return rows.withColumn("expected", before).where(F.col("expected").isNotNull() & (F.col("expected") != F.col(start)))
