"""Candidate search: which kernel and size a signal was made with.

Candidates are kernels x sizes. Each one is undone, made again, and compared with the signal; samples
never leave the worker, which returns a row of measures for each signal and candidate. Plans of the
candidates are built side by side by the worker and shared by all signals of its batches.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refold.functions.kernels import Kernel
from refold.plans.planner import build
from refold.plans.requests import Request

from . import solve
from .resample import arrays

MEASURES = "max_abs double, mae double, mse double, rmse double, psnr double, thresholded_mae double, fraction_over double"


def tenths(first: int, last: int) -> Column:
    """first / 10, ... , last / 10 as exact quotients."""
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda n: n / F.lit(10.0))


def heights(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(1).select(F.posexplode(tenths(first, last)).alias("pos", "height"))


def stratified(rows: DataFrame, n: int, k: int) -> DataFrame:
    """The middle of each of k equal strata of n rows numbered `pos`."""
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor((2 * i + 1) * n / (2 * k)).cast("int"))
    return rows.where(F.array_contains(places, F.col("pos")))


def candidates(scalers: DataFrame, sizes: DataFrame, repetitions: int = 1) -> DataFrame:
    """Every repetition, scaler (s_pos, scaler) and height (pos, height), numbered in that nesting. The
    lists are literals of a recipe, so all pairs are what is asked for."""
    n_s, n_h = scalers.count(), sizes.count()
    rep = scalers.sparkSession.range(repetitions).select(F.col("id").cast("int").alias("rep"))
    every = rep.crossJoin(F.broadcast(scalers)).crossJoin(F.broadcast(sizes))
    place = (F.col("rep") * n_s + F.col("s_pos")) * n_h + F.col("pos")
    return every.select(place.cast("long").alias("idx"), "rep", "scaler", "height", F.format_string("%s@%.1f", "scaler", "height").alias("id"))


def centred(height: Column, base_width: Column | int, base_height: int) -> dict[str, Column]:
    """The whole canvas that a fractional height is centred on, and the window in it."""
    size = lambda base, h: base - 2 * F.floor((base - h) / 2).cast("int")
    b = F.lit(base_width) if isinstance(base_width, int) else base_width
    width = height * b / base_height
    out_h, out_w = size(F.lit(base_height), height), size(b, width)
    return {"out_height": out_h, "src_top": (out_h - height) / 2, "out_width": out_w.cast("int"), "src_left": (out_w - width) / 2, "src_height": height, "src_width": width}


def accumulated(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... below stop, each the sum so far (not start + k * step)."""
    out, at = [], float(start)
    while at < stop:
        out.append(at)
        at += step
    return out


# The published recipes, in their order.
GETNATIVE = [
    Kernel("bilinear"),
    Kernel("bicubic", b=1 / 3, c=1 / 3),
    Kernel("bicubic", b=0.0, c=0.5),
    Kernel("bicubic", b=0.0, c=1.0),
    Kernel("bicubic", b=1.0, c=0.0),
    Kernel("bicubic", b=0.0, c=0.75),
    Kernel("lanczos", 2),
    Kernel("lanczos", 3),
    Kernel("lanczos", 4),
    Kernel("spline16"),
    Kernel("spline36"),
]
GETNATIVE_V2 = [*GETNATIVE[:6], Kernel("spline16"), Kernel("spline36")]
STRATIFIED = [GETNATIVE[k] for k in (0, 2, 7, 10)]


def grid() -> list[Kernel]:
    """Bilinear, then bicubic kernels with b and c from 0 to 0.9 in accumulated tenths, b the outer one."""
    values = accumulated(0, 1, 0.1)[:10]
    return [Kernel("bilinear"), *[Kernel("bicubic", b=b, c=c) for b in values for c in values]]


@functools.lru_cache(64)
def _plans(recipe: tuple) -> list:
    """Plans by candidate; kept for the worker's next batches."""
    kernels, sizes, n, border = recipe
    wanted = []
    for k in kernels:
        for size in sizes:
            whole = n - 2 * int((n - size) / 2)
            wanted.append(Request(n, whole, float(size), (whole - size) / 2, k, border, "auto"))
    return build(wanted)


def search(signals: DataFrame, samples: str, kernels: list[Kernel], sizes: list[float], n: int, keys: tuple[str, ...], threshold: float = 0.015, mode: str = "keep_under", edge: int = 5, border: str = "symmetric") -> DataFrame:
    """Measures of every candidate for every signal (array of n samples): keys, idx, scaler, family, size,
    then MEASURES. The outer `edge` samples don't count. A narrow map: signals stay where they are."""
    recipe = (tuple(kernels), tuple(sizes), n, border)
    labels = [(k.name, k.kind, float(s)) for k in kernels for s in sizes]
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = _plans(recipe)
        for b in batches:
            y = np.array(b.column(samples).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, n).T.copy()
            if not b.num_rows:
                continue
            for idx, (plan, (scaler, family, size)) in enumerate(zip(plans, labels, strict=True)):
                x = solve.inverse(plan, y).astype(np.float32)
                values = measures(y[edge : n - edge], solve.forward(plan, x)[edge : n - edge], threshold, mode)
                r = b.num_rows
                own = [b.column(k) for k in keys]
                yield pa.record_batch(
                    [*own, pa.array(np.full(r, idx)), pa.array([scaler] * r), pa.array([family] * r), pa.array(np.full(r, size)), *(pa.array(v, from_pandas=True) for v in values)],
                    names=[*keys, "idx", "scaler", "family", "size", *names],
                )

    schema = ", ".join(f"{k} {signals.schema[k].dataType.simpleString()}" for k in keys)
    return signals.select(*keys, samples).mapInArrow(run, f"{schema}, idx long, scaler string, family string, size double, {MEASURES}")


def measures(y: np.ndarray, again: np.ndarray, threshold: float, mode: str) -> list[np.ndarray]:
    """MEASURES down the columns: differences and squares in single precision, means in double."""
    d = np.abs(y - again).astype(np.float32)
    over = d > np.float32(threshold)
    mse = (d * d).mean(0, dtype=np.float64)
    with np.errstate(divide="ignore"):
        psnr = np.where(mse > 0, -10 * np.log10(mse), np.nan)
    counts = over if mode == "keep_over" else ~over
    return [d.max(0).astype(np.float64), d.mean(0, dtype=np.float64), mse, np.sqrt(mse), psnr, np.where(counts, d, 0).mean(0, dtype=np.float64), over.mean(0)]


def plane_search(spark: SparkSession, clip, kernels: list[Kernel], sizes: list[float], tasks: int, threshold: float = 0.015, mode: str = "keep_under", edge: int = 5, border: str = "symmetric", vertical_only: bool = False) -> DataFrame:
    """Measures of every candidate on the frames of a clip: frame_no, plane, idx, scaler, family, size,
    MEASURES. Candidates are dealt over tasks and each meets every frame, so a task plans only its own
    candidates; frames cross to the tasks once each, as rows."""
    width, height = clip.width, clip.height
    labels = [(k, float(s)) for k in kernels for s in sizes]
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for frame_no, plane, part, samples in zip(*(b.column(c).to_pylist() for c in ("frame_no", "plane", "part")), arrays(b.column("samples")), strict=True):
                y = np.asarray(samples, np.float32).reshape(height, width)
                mine = range(part, len(labels), tasks)
                for at in range(0, len(mine), CHUNK):
                    rows = [(frame_no, plane, i, *_scored(y, labels[i], plans, threshold, mode, edge)) for i, plans in _planned(mine[at : at + CHUNK], labels, width, height, border, vertical_only)]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), *[pa.float64()] * 8), strict=True)], names=["frame_no", "plane", "idx", "scaler", "family", "size", *names])

    dealt = clip.rows.select("frame_no", "plane", "samples", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("part")).repartition(tasks, "part")
    return dealt.mapInArrow(run, f"frame_no int, plane int, idx long, scaler string, family string, size double, {MEASURES}")


#: Candidates planned side by side.
CHUNK = 32


def _planned(places, labels: list, width: int, height: int, border: str, vertical_only: bool) -> list:
    """(place, plans of its axes) for each place."""
    wanted = [_axes(labels[i], width, height, border, vertical_only) for i in places]
    plans = iter(build([r for w in wanted for r in w]))
    return [(i, [next(plans) for _ in w]) for i, w in zip(places, wanted, strict=True)]


def _scored(y: np.ndarray, label: tuple, plans: list, threshold: float, mode: str, edge: int) -> tuple:
    again = _again(y, *plans, *[None] * (2 - len(plans)))
    inner = (slice(edge, y.shape[0] - edge), slice(edge, y.shape[1] - edge))
    m = measures(y[inner].reshape(-1, 1), again[inner].reshape(-1, 1), threshold, mode)
    return label[0].name, label[0].kind, label[1], *(None if np.isnan(x[0]) else float(x[0]) for x in m)


def _axes(label: tuple, width: int, height: int, border: str, vertical_only: bool) -> list[Request]:
    kernel, size = label
    wide = size * width / height
    out = []
    for n, active in ((height, size), (width, wide))[: 1 if vertical_only else 2]:
        whole = n - 2 * int((n - active) / 2)
        out.append(Request(n, whole, active, (whole - active) / 2, kernel, border, "auto"))
    return out


def _again(y: np.ndarray, v, h) -> np.ndarray:
    """The plane undone along both axes and made again."""
    x = solve.inverse(v, y).astype(np.float32)
    if h is None:
        return solve.forward(v, x)
    x = solve.inverse(h, np.ascontiguousarray(x.T)).astype(np.float32)
    return solve.forward(v, np.ascontiguousarray(solve.forward(h, x).T))
