"""Inverse and forward resampling of clips: checked eagerly, planned once, mapped without shuffle.

At most four plans are needed for a clip (two axes, luma and chroma). They are built on the driver,
their size depends on the frame size only, and they travel with the function. Planes of equal shape in
an Arrow batch (bounded by spark.sql.execution.arrow.maxBytesPerBatch) are solved side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refold.functions.borders import BORDER_HANDLING, PADDING
from refold.functions.kernels import Kernel
from refold.functions.numbers import is_full_range, sample_range
from refold.plans.cache import PLANS
from refold.plans.planner import Plan, build
from refold.plans.requests import Request

from . import solve
from .clips import COLUMNS, PLANE, Clip, join_planes

F64 = {0: "auto", 1: "f32", 2: "f64"}
ENGINES = ("auto", "cpu")


def inverse_resample(
    clip: Clip, width: int, height: int, kernel: str | None = None, *, taps: int | None = None, support: int | None = None, b: float = 0.0, c: float = 0.5, blur: float = 1.0,
    src_left: float = 0.0, src_top: float = 0.0, src_width: float | None = None, src_height: float | None = None, border_handling: int | None = None, padding: int | None = None,
    force: bool = False, force_h: bool = False, force_v: bool = False, f64mode: int = 0, custom=None, custom_kernel=None, backend: str = "auto",
) -> Clip:
    """The clip at width x height whose interpolation comes closest to the given one.

    An axis is worked on if its size changes, its window isn't the whole, or it is forced; if neither
    is, the clip comes back as it is. custom wins over custom_kernel, taps over support.
    """
    if backend not in ENGINES:
        raise ValueError(f"backend is not available: {backend}")
    weight = custom or custom_kernel
    if kernel and weight:
        raise ValueError("kernel and custom kernel cannot both be given")
    if weight and taps is None and support is None:
        raise ValueError("custom kernel needs taps or support")
    count = taps if taps is not None else support if support is not None else 3
    shape = Kernel("custom" if weight else kernel or "bicubic", count, b, c, blur, weight)
    _check_sizes(clip, width, height, blur)
    border, mode = _border(border_handling, padding), _mode(f64mode)
    across, down = float(width if src_width is None else src_width), float(height if src_height is None else src_height)
    h = width != clip.width or src_left != 0 or across != width or force or force_h
    v = height != clip.height or src_top != 0 or down != height or force or force_v
    if not h and not v:
        return clip
    requests: dict[tuple[str, bool], Request] = {}
    for chroma in (False, True)[: 1 + (clip.family == "YUV" and bool(clip.sub_w or clip.sub_h))]:
        sw, sh = (clip.sub_w, clip.sub_h) if chroma else (0, 0)
        if h:
            small = clip.width >> sw
            part = small / clip.width
            offset = 0.25 - 0.25 * width / clip.width if sw else 0.0  # chroma sits on the left samples
            requests["h", chroma] = Request(small, width >> sw, across * part, offset + src_left * part, shape, border, mode)
        if v:
            small = clip.height >> sh
            part = small / clip.height
            requests["v", chroma] = Request(small, height >> sh, down * part, src_top * part, shape, border, mode)
    plans = dict(zip(requests, PLANS.get(requests.values()), strict=True))
    return clip.of(_mapped(clip, plans, width, height), width=width, height=height)


def _check_sizes(clip: Clip, width: int, height: int, blur: float) -> None:
    if width < 1 or height < 8:
        raise ValueError("output dimensions are too small")
    if width > clip.width or height > clip.height:
        raise ValueError("output dimensions must not exceed the input's")
    if width % (1 << clip.sub_w) or height % (1 << clip.sub_h):
        raise ValueError("output dimensions must be divisible by the subsampling")
    if not 0 < blur < min(clip.width >> clip.sub_w, clip.height >> clip.sub_h):
        raise ValueError("blur must be finite, greater than zero and less than the smallest plane")


def _border(handling: int | None, padding: int | None) -> str:
    if handling is not None and padding is not None:
        raise ValueError("border_handling and padding cannot both be given")
    if padding is not None:
        if padding not in PADDING:
            raise ValueError("padding must be 0 to 3")
        return PADDING[padding]
    if (handling or 0) not in BORDER_HANDLING:
        raise ValueError("border_handling must be 0 to 2")
    return BORDER_HANDLING[handling or 0]


def _mode(f64mode: int) -> str:
    if f64mode not in F64:
        raise ValueError("f64mode must be 0 to 2")
    return F64[f64mode]


def _mapped(clip: Clip, plans: dict[tuple[str, bool], Plan], width: int, height: int) -> DataFrame:
    family, bits, subsampled = clip.family, clip.bits, bool(clip.sub_w or clip.sub_h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _solved(batch, plans, family, bits, subsampled)

    return clip.rows.select(*COLUMNS).mapInArrow(run, clip.rows.select(*COLUMNS).schema)


def _solved(batch: pa.RecordBatch, plans, family: str, bits: int, subsampled: bool) -> pa.RecordBatch:
    given = arrays(batch.column("samples"))
    rows = list(zip(*(batch.column(c).to_pylist() for c in ("plane", "width", "height", "props")), strict=True))
    groups: dict[tuple, list[int]] = {}
    for k, (plane, w, h, props) in enumerate(rows):
        chroma = family == "YUV" and plane > 0
        full = is_full_range(dict(props or ()), family == "RGB") if bits < 32 else None
        groups.setdefault((w, h, chroma, full), []).append(k)
    out: list = [None] * len(rows)
    for (w, h, chroma, full), members in groups.items():
        across, down = (plans.get((a, chroma and subsampled)) for a in "hv")
        codes = sample_range(bits, full, chroma) if bits < 32 else None
        side = max(1, SIDE // (w * h))
        for at in range(0, len(members), side):
            some = members[at : at + side]
            made = _planes(across, down, np.stack([given[k].reshape(h, w) for k in some]), codes)
            for k, plane in zip(some, made, strict=True):
                out[k] = plane
    columns = {c: batch.column(c) for c in COLUMNS} | {"samples": column(out, batch.column("samples").type)}
    columns |= {"width": pa.array([p.shape[1] for p in out], pa.int32()), "height": pa.array([p.shape[0] for p in out], pa.int32())}
    return pa.record_batch([columns[c] for c in COLUMNS], names=list(COLUMNS))


#: Samples of small planes solved side by side.
SIDE = 1 << 20


def arrays(samples: pa.Array) -> list[np.ndarray]:
    """Each row's samples, from a list column or a packed one (little-endian 32-bit floats), as views."""
    if pa.types.is_binary(samples.type) or pa.types.is_large_binary(samples.type):
        return [np.frombuffer(x.as_buffer(), "<f4") for x in samples]
    flat, at = samples.flatten().to_numpy(zero_copy_only=False), samples.offsets.to_numpy()
    return [flat[a - at[0] : b - at[0]] for a, b in zip(at[:-1], at[1:], strict=True)]


def column(planes: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Planes as a column of the given type, list or packed."""
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return pa.array([np.ascontiguousarray(p, "<f4").tobytes() for p in planes], kind)
    at = np.cumsum([0, *(p.size for p in planes)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([p.ravel() for p in planes]).astype(np.float32))).cast(kind)


def _planes(h: Plan | None, v: Plan | None, stack: np.ndarray, codes) -> np.ndarray:
    """A stack (plane, height, width) with both axes undone; all planes' lanes run side by side."""
    double = bool(h and h.double or v and v.double)
    kind = np.float64 if double else np.float32
    x = codes.decode(stack, kind) if codes else stack.astype(kind)
    if not double:
        if h:
            x = solve.inverse_single(h, x.reshape(-1, x.shape[2]), across=True).reshape(len(x), -1, h.request.destination_size)
        if v:
            x = np.stack([solve.inverse_single(v, p) for p in x])
        return codes.encode(x) if codes else x
    for plan, along in ((h, 2), (v, 1)):
        if plan:
            lanes = np.moveaxis(x, along, 0)
            x = np.moveaxis(solve.inverse_double(plan, np.ascontiguousarray(lanes).reshape(lanes.shape[0], -1)).reshape(-1, *lanes.shape[1:]), 0, along)
    return codes.encode(x) if codes else x


def forward_resample(clip: Clip, width: int, height: int, kernel: Kernel, *, src_left: float = 0.0, src_top: float = 0.0, src_width: float | None = None, src_height: float | None = None, border: str = "symmetric") -> Clip:
    """Interpolation of a window of the clip to width x height (either may grow or shrink)."""
    across, down = (build([Request(n, s, float(s if a is None else a), o, kernel, border, "f64")])[0] for n, s, a, o in ((width, clip.width, src_width, src_left), (height, clip.height, src_height, src_top)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(*(batch.column(c).to_pylist() for c in ("width", "height")), strict=True)
            made = [_forward(across, down, s.astype(np.float64).reshape(h, w)) for s, (w, h) in zip(arrays(batch.column("samples")), sizes, strict=True)]
            columns = {c: batch.column(c) for c in COLUMNS} | {"samples": column(made, batch.column("samples").type), "width": pa.array([width] * len(made), pa.int32()), "height": pa.array([height] * len(made), pa.int32())}
            yield pa.record_batch([columns[c] for c in COLUMNS], names=list(COLUMNS))

    return clip.of(clip.rows.select(*COLUMNS).mapInArrow(run, clip.rows.select(*COLUMNS).schema), width=width, height=height)


def _forward(across: Plan, down: Plan, plane: np.ndarray) -> np.ndarray:
    return solve.forward(down, np.ascontiguousarray(solve.forward(across, np.ascontiguousarray(plane.T)).T)).astype(np.float32)


def debilinear(clip, width, height, **args):
    return inverse_resample(clip, width, height, "bilinear", **args)


def debicubic(clip, width, height, b=0.0, c=0.5, **args):
    return inverse_resample(clip, width, height, "bicubic", b=b, c=c, **args)


def delanczos(clip, width, height, taps=3, **args):
    return inverse_resample(clip, width, height, "lanczos", taps=taps, **args)


def despline16(clip, width, height, **args):
    return inverse_resample(clip, width, height, "spline16", **args)


def despline36(clip, width, height, **args):
    return inverse_resample(clip, width, height, "spline36", **args)


def despline64(clip, width, height, **args):
    return inverse_resample(clip, width, height, "spline64", **args)


def decustom(clip, width, height, weight, taps, **args):
    return inverse_resample(clip, width, height, custom=weight, taps=taps, **args)


def convert(clip: Clip, bits: int) -> Clip:
    """Another sample format, without dither; bits 32 is float."""
    if bits == clip.bits:
        return clip
    rgb, chroma = clip.family == "RGB", F.col("plane") > 0 if clip.family == "YUV" else F.lit(False)
    full = F.coalesce(F.coalesce(F.try_element_at("props", F.lit("_Range")), F.try_element_at("props", F.lit("_ColorRange"))) == 1, F.lit(rgb))
    pick = lambda f: F.when(full & chroma, f(True, True)).when(full, f(True, False)).when(chroma, f(False, True)).otherwise(f(False, False))
    rows = clip.rows
    if clip.bits < 32:
        rows = rows.withColumn("samples", pick(lambda a, b: F.transform("samples", lambda x: sample_range(clip.bits, a, b).decode_column(x).cast("float"))))
    if bits < 32:
        rows = rows.withColumn("samples", pick(lambda a, b: F.transform("samples", lambda x: sample_range(bits, a, b).encode_column(x).cast("float"))))
    return clip.of(rows, bits=bits)


def inverse_by_family(clip: Clip, width: int, height: int, kernel: str, gray: bool = False, **args) -> Clip:
    """By family: RGB and gray plane by plane; YUV with luma undone and chroma brought to the new size by
    spline36, unless gray is asked for or chroma has luma's size."""
    if clip.family != "YUV" or not (clip.sub_w or clip.sub_h) and not gray:
        return inverse_resample(clip, width, height, kernel, **args)
    luma = inverse_resample(Clip(clip.rows.where(F.col("plane") == 0), clip.width, clip.height, "GRAY", clip.bits), width, height, kernel, **args)
    if gray:
        return luma
    chroma = Clip(clip.rows.where(F.col("plane") > 0), clip.width >> clip.sub_w, clip.height >> clip.sub_h, "GRAY", clip.bits)
    moved = forward_resample(chroma, width >> clip.sub_w, height >> clip.sub_h, Kernel("spline36"))
    return join_planes(luma, moved.of(moved.rows, sub_w=clip.sub_w, sub_h=clip.sub_h)).of(luma.rows.unionByName(moved.rows), width=width, height=height)


def inverse_rows(df: DataFrame, samples: str, request: Request, keys: tuple[str, ...]) -> DataFrame:
    """The inverse along one axis for arrays of samples: keys and `samples` at the destination size, in
    double if the plan is, else single precision."""
    plan = build([request])[0]
    kind, listed = ("double", pa.float64()) if plan.double else ("float", pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.array(b.column(samples).flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, -1)
            if b.num_rows:
                x = solve.inverse(plan, np.ascontiguousarray(y.T)).T
                at = pa.array(np.arange(b.num_rows + 1) * x.shape[1], pa.int32())
                yield pa.record_batch([*(b.column(k) for k in keys), pa.ListArray.from_arrays(at, pa.array(x.ravel(), listed))], names=[*keys, "samples"])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, samples).mapInArrow(run, f"{schema}, samples array<{kind}>")


def packed(clip: Clip) -> Clip:
    """The clip with each plane's samples as bytes of little-endian 32-bit floats: Arrow and Spark then
    move a plane as one value. Resampling and plane search take either form; `unpacked` goes back."""
    return clip.of(_recast(clip.rows, "binary"))


def unpacked(clip: Clip) -> Clip:
    return clip.of(_recast(clip.rows, "array<float>"))


def _recast(rows: DataFrame, kind: str) -> DataFrame:
    listed = pa.binary() if kind == "binary" else pa.list_(pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {c: b.column(c) for c in COLUMNS} | {"samples": column([np.asarray(x, np.float32) for x in arrays(b.column("samples"))], listed)}
            yield pa.record_batch([columns[c] for c in COLUMNS], names=list(COLUMNS))

    shape = T.StructType([f if f.name != "samples" else T.StructField("samples", T.BinaryType() if kind == "binary" else T.ArrayType(T.FloatType())) for f in PLANE.fields])
    return rows.select(*COLUMNS).mapInArrow(run, shape)
