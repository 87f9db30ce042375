"""Clips as DataFrames with one row for each plane, and the usual operations on frames.

A row holds a whole plane, so whatever works within a plane is a narrow map, and frame selection is a
filter that the scan can prune by.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refold.functions import digests

PLANE = T.StructType(
    [
        T.StructField("clip_id", T.StringType()),
        *[T.StructField(n, T.IntegerType()) for n in ("frame_no", "plane", "width", "height")],
        T.StructField("samples", T.ArrayType(T.FloatType())),
        T.StructField("props", T.MapType(T.StringType(), T.LongType())),
    ]
)
COLUMNS = tuple(PLANE.fieldNames())


@dataclass(frozen=True)
class Clip:
    """rows: PLANE rows. family: GRAY, YUV or RGB. bits: 32 for float samples, 8..16 for codes.
    sub_w, sub_h: chroma planes are narrower by 2 ** sub."""

    rows: DataFrame
    width: int
    height: int
    family: str = "GRAY"
    bits: int = 32
    sub_w: int = 0
    sub_h: int = 0

    def of(self, rows: DataFrame, **changes) -> Clip:
        return replace(self, rows=rows, **changes)

    @property
    def planes(self) -> int:
        return 1 if self.family == "GRAY" else 3


def blank(spark: SparkSession, width: int, height: int, length: int, colour: float = 0.0, clip_id: str = "blank") -> Clip:
    """A constant clip."""
    rows = spark.range(length).select(
        F.lit(clip_id).alias("clip_id"), F.col("id").cast("int").alias("frame_no"), F.lit(0).alias("plane"), F.lit(width).alias("width"), F.lit(height).alias("height"),
        F.array_repeat(F.lit(float(colour)).cast("float"), width * height).alias("samples"), F.create_map().cast("map<string,bigint>").alias("props"),
    )
    return Clip(rows, width, height)


def pattern(spark: SparkSession, width: int, height: int, length: int, value, clip_id: str = "pattern", planes: int = 1) -> Clip:
    """A clip from a formula: value(frame, plane, y, x) as Columns."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda k: value(F.col("frame_no"), F.col("plane"), F.floor(k / width).cast("int"), (k % width).cast("int")).cast("float"))
    rows = spark.range(length * planes).select(F.lit(clip_id).alias("clip_id"), F.floor(F.col("id") / planes).cast("int").alias("frame_no"), (F.col("id") % planes).cast("int").alias("plane"), F.lit(width).alias("width"), F.lit(height).alias("height"))
    rows = rows.withColumn("samples", grid).withColumn("props", F.create_map().cast("map<string,bigint>"))
    return Clip(rows, width, height, "GRAY" if planes == 1 else "RGB")


def frame(clip: Clip, n: int) -> Clip:
    return clip.of(clip.rows.where(F.col("frame_no") == n))


def trim(clip: Clip, first: int, last: int) -> Clip:
    """Frames first..last, numbered from 0."""
    rows = clip.rows.where(F.col("frame_no").between(first, last))
    return clip.of(rows.withColumn("frame_no", (F.col("frame_no") - first).cast("int")))


def loop(clip: Clip, times: int, length: int) -> Clip:
    """A clip of `length` frames, `times` times over."""
    again = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    rows = clip.rows.withColumn("again", again).withColumn("frame_no", (F.col("again") * length + F.col("frame_no")).cast("int"))
    return clip.of(rows.drop("again"))


def splice(clips: list[tuple[Clip, int]]) -> Clip:
    """Clips of known lengths, one after another."""
    at, rows = 0, None
    for clip, length in clips:
        moved = clip.rows.withColumn("frame_no", (F.col("frame_no") + at).cast("int"))
        rows = moved if rows is None else rows.unionByName(moved)
        at += length
    return clips[0][0].of(rows)


def take_plane(clip: Clip, plane: int) -> Clip:
    """One plane as a gray clip."""
    rows = clip.rows.where(F.col("plane") == plane).withColumn("plane", F.lit(0))
    small = plane > 0 and clip.family == "YUV"
    return clip.of(rows, family="GRAY", width=clip.width >> clip.sub_w * small, height=clip.height >> clip.sub_h * small, sub_w=0, sub_h=0)


def join_planes(luma: Clip, chroma: Clip) -> Clip:
    """Plane 0 of one clip, planes 1 and 2 of another."""
    rows = luma.rows.where(F.col("plane") == 0).unionByName(chroma.rows.where(F.col("plane") > 0))
    return luma.of(rows, family="YUV", sub_w=chroma.sub_w, sub_h=chroma.sub_h)


def _rows_of(samples: Column, width: Column, height: Column, first, count, top, rows) -> Column:
    """Samples of a window, row by row."""
    each = F.transform(F.sequence(top, top + rows - 1), lambda y: F.slice(samples, y * width + first + 1, count))
    return F.flatten(each)


def crop(clip: Clip, left: int, right: int, top: int, bottom: int) -> Clip:
    """Without the given borders."""
    w, h = F.col("width"), F.col("height")
    if left + right >= clip.width or top + bottom >= clip.height:
        raise ValueError("nothing is left of the frame")
    rows = clip.rows.withColumn("samples", _rows_of(F.col("samples"), w, h, F.lit(left), w - left - right, F.lit(top), h - top - bottom))
    rows = rows.withColumns({"width": (w - left - right).cast("int"), "height": (h - top - bottom).cast("int")})
    return clip.of(rows, width=clip.width - left - right, height=clip.height - top - bottom)


def add_borders(clip: Clip, left: int, right: int, top: int, bottom: int, colour: float = 0.0) -> Clip:
    w, h = F.col("width"), F.col("height")
    fill = lambda n: F.array_repeat(F.lit(float(colour)).cast("float"), n)
    wide = w + left + right
    middle = F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.concat(fill(F.lit(left)), F.slice("samples", y * w + 1, w), fill(F.lit(right)))))
    rows = clip.rows.withColumn("samples", F.concat(fill(wide * top), middle, fill(wide * bottom)))
    rows = rows.withColumns({"width": wide.cast("int"), "height": (h + top + bottom).cast("int")})
    return clip.of(rows, width=clip.width + left + right, height=clip.height + top + bottom)


def expr(clips: list[Clip], formula) -> Clip:
    """Per-sample formula over one clip (Column -> Column) or two, joined by frame and plane."""
    if len(clips) == 1:
        return clips[0].of(clips[0].rows.withColumn("samples", F.transform("samples", lambda x: formula(x).cast("float"))))
    a, b = clips
    other = b.rows.select("frame_no", "plane", F.col("samples").alias("other"))
    rows = a.rows.join(other, ["frame_no", "plane"])
    return a.of(rows.withColumn("samples", F.zip_with("samples", "other", lambda x, y: formula(x, y).cast("float"))).select(*COLUMNS))


def absolute_difference(x: Column, y: Column) -> Column:
    return F.abs(x - y)


def keep_over(threshold: float):
    """Differences above the threshold; the rest count as 0."""
    t = F.lit(threshold).cast("float")
    return lambda x, y: F.when(F.abs(x - y) > t, F.abs(x - y)).otherwise(F.lit(0.0).cast("float"))


def keep_under(threshold: float):
    """Differences at or below the threshold; larger ones count as 0."""
    t = F.lit(threshold).cast("float")
    return lambda x, y: F.when(F.abs(x - y) > t, F.lit(0.0).cast("float")).otherwise(F.abs(x - y))


def plane_stats(rows: DataFrame, samples: str = "samples", *keys: str) -> DataFrame:
    """average, minimum and maximum of each row's samples; sums in double precision."""
    s = F.col(samples)
    total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return rows.select(*keys, (total / F.size(s)).alias("average"), F.array_min(s).alias("minimum"), F.array_max(s).alias("maximum"))


def compare(rows: DataFrame, x: str, y: str, threshold: float, mode: str = "keep_under", *keys: str) -> DataFrame:
    """Error measures of two sample columns in one pass over the arrays. Differences and squares are
    single precision, means double. mode: which differences count in thresholded_mae."""
    t, one = F.lit(threshold).cast("float"), F.lit(1.0)
    d = F.zip_with(x, y, lambda a, b: F.abs(a - b).cast("float"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("t"), F.lit(0.0).alias("o"), F.lit(0.0).cast("float").alias("m"))

    def step(acc, v):
        over = v > t
        counts = over if mode == "keep_over" else ~over
        return F.struct(
            (acc["s"] + v.cast("double")).alias("s"), (acc["q"] + (v * v).cast("float").cast("double")).alias("q"),
            (acc["t"] + F.when(counts, v.cast("double")).otherwise(0.0)).alias("t"), (acc["o"] + F.when(over, one).otherwise(0.0)).alias("o"), F.greatest(acc["m"], v).alias("m"),
        )

    r, n = F.col("__r"), F.size(x)
    mse = r["q"] / n
    out = rows.withColumn("__r", F.aggregate(d, zero, step))
    return out.select(
        *keys, r["m"].alias("max_abs"), (r["s"] / n).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
        F.when(r["q"] > 0, -10 * F.log10(F.when(r["q"] > 0, mse))).alias("psnr"), (r["t"] / n).alias("thresholded_mae"), (r["o"] / n).alias("fraction_over"),
    )


def differences(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """mae and max_abs of two sample columns, differences and sums in double precision."""
    d = F.zip_with(x, y, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return rows.select(*keys, F.try_divide(F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v), F.size(d)).alias("mae"), F.array_max(d).alias("max_abs"))


def segments(rows: DataFrame, order: str, value: str, *partition: str) -> DataFrame:
    """rows with `segment`: a new one begins where the value changes along the order."""
    w = Window.partitionBy(*partition).orderBy(order)
    change = (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int")
    return rows.withColumn("segment", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def frame_eval(clip: Clip, choices: DataFrame, key: str, apply) -> DataFrame:
    """Per-frame choice: frame n meets row n of `choices`; apply(Column of samples) may use its columns."""
    return clip.rows.join(choices, clip.rows.frame_no == choices[key]).withColumn("samples", apply(F.col("samples"))).drop(key)


def digest(rows: DataFrame, samples: str, *keys: str) -> DataFrame:
    """SHA-256 of the bytes of each row's samples as little-endian single precision."""
    return rows.select(*keys, digests.samples_sha256(F.col(samples).cast("array<float>")).alias("digest"))
