"""The planner as relations: taps, the sparse matrix, normal bands and right-hand sides as DataFrames.

A request has source_size x taps rows at most; they are generated, not shuffled, up to the sums over
equal places. Arrays keep each source sample's taps together, so weights are normalised in its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refold.functions import borders
from refold.functions.numbers import round_half_up_column

from .requests import Request


def taps(spark: SparkSession, r: Request, req_id: str) -> DataFrame:
    """req_id, src, tap, dst (-1: dropped by the border), distance, w."""
    s = r.kernel.support
    row = F.col("id")
    position = (row + F.lit(0.5)) / F.lit(r.source_size / r.active_length) + F.lit(float(r.shift))
    placed = spark.range(r.source_size).select(row.cast("int").alias("src"), position.alias("p")).withColumn("first", round_half_up_column(F.col("p") - s))
    tap = lambda k: F.col("first") + k
    each = F.transform(F.sequence(F.lit(0), F.lit(2 * s - 1)), lambda k: F.struct(tap(k).alias("at"), (tap(k) + F.lit(0.5) - F.col("p")).alias("distance"), r.kernel.column(tap(k) + F.lit(0.5) - F.col("p")).alias("k")))
    total = F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x["k"])
    rows = placed.withColumn("t", each).withColumn("total", total).select("src", "total", F.posexplode("t").alias("tap", "x"))
    return rows.select(F.lit(req_id).alias("req_id"), "src", "tap", borders.column(F.col("x.at"), r.destination_size, r.border).cast("int").alias("dst"), F.col("x.distance").alias("distance"), (F.col("x.k") / F.col("total")).alias("w"))


def coo(taps_: DataFrame) -> DataFrame:
    """req_id, src, dst, w: taps on one place are added up."""
    used = taps_.where((F.col("dst") >= 0) & (F.col("w") != 0))
    return used.groupBy("req_id", "src", "dst").agg(F.sum("w").alias("w"))


def normal_bands(matrix: DataFrame, half_bandwidth: int) -> DataFrame:
    """req_id, i, d, g: the sum over source samples of A[., i] A[., i + d]. A self-join on the source
    sample with a band as the residual; a source sample has a few entries, so this grows with them only."""
    a = matrix.select("req_id", "src", F.col("dst").alias("i"), F.col("w").alias("wa"))
    b = matrix.select("req_id", "src", F.col("dst").alias("j"), F.col("w").alias("wb"))
    d = F.col("j") - F.col("i")
    return a.join(b, ["req_id", "src"]).where(d.between(0, half_bandwidth)).groupBy("req_id", "i", d.alias("d")).agg(F.sum(F.col("wa") * F.col("wb")).alias("g"))


def right_sides(matrix: DataFrame, signals: DataFrame, key: str, samples: str) -> DataFrame:
    """req_id, key, i, v: A'y for each signal. The matrix is bounded by its request and is broadcast, and
    each signal's products are summed before they are shuffled."""
    y = signals.select(key, F.posexplode(samples).alias("src", "y"))
    return y.join(F.broadcast(matrix), "src").groupBy("req_id", key, F.col("dst").alias("i")).agg(F.sum(F.col("w") * F.col("y").cast("double")).alias("v"))


def band_norm(bands: DataFrame) -> DataFrame:
    """req_id, one_norm, margin: the greatest column sum, and the least excess of the diagonal over the
    rest of its row."""
    size = F.abs("g")
    both = bands.select("req_id", F.col("i").alias("k"), "d", size.alias("g")).unionByName(bands.where("d > 0").select("req_id", (F.col("i") + F.col("d")).alias("k"), "d", size.alias("g")))
    by = both.groupBy("req_id", "k").agg(F.sum("g").alias("s"), F.sum(F.when(F.col("d") == 0, F.col("g")).otherwise(0.0)).alias("diagonal"))
    return by.groupBy("req_id").agg(F.max("s").alias("one_norm"), F.min(2 * F.col("diagonal") - F.col("s")).alias("margin"))
