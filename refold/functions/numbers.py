"""Roundings and sample conversions whose results must not follow an engine's defaults."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(v: np.ndarray) -> np.ndarray:
    """Halves go up, also below zero: -2.5 gives -2, and 0.49999999999999994 gives 0."""
    low = np.floor(v)
    return low + (v - low >= 0.5)


def round_half_up_column(v: Column) -> Column:
    low = F.floor(v)
    return F.when(v - low >= 0.5, low + 1).otherwise(low).cast("long")


@dataclass(frozen=True)
class Range:
    """How whole numbers stand for samples: code = sample * scale + offset, from 0 to maximum."""

    offset: float
    scale: float
    maximum: int

    def decode(self, codes: np.ndarray, kind=np.float32) -> np.ndarray:
        return ((codes.astype(kind) - kind(self.offset)) * kind(1 / self.scale)).astype(kind)

    def encode(self, samples: np.ndarray) -> np.ndarray:
        """Scaled, kept in range, rounded to even."""
        kind = samples.dtype.type
        return np.rint(np.clip(samples * kind(self.scale) + kind(self.offset), 0, self.maximum))

    def decode_column(self, code: Column) -> Column:
        return (code - F.lit(float(self.offset))) * F.lit(1 / self.scale)

    def encode_column(self, sample: Column) -> Column:
        return F.rint(F.least(F.greatest(sample * F.lit(float(self.scale)) + F.lit(float(self.offset)), F.lit(0.0)), F.lit(float(self.maximum)))).cast("int")


def sample_range(bits: int, full: bool, chroma: bool = False) -> Range:
    """The range of a format: limited luma 16..235 and chroma 16..240 at 8 bits, wider at more."""
    if not 8 <= bits <= 16:
        raise ValueError("bits must be 8 to 16")
    top, step = (1 << bits) - 1, 1 << (bits - 8)
    if full:
        return Range(float(1 << (bits - 1)) if chroma else 0.0, float(top), top)
    return Range(float((128 if chroma else 16) * step), float((224 if chroma else 219) * step), top)


def is_full_range(props: dict | None, rgb: bool) -> bool:
    """_Range wins over _ColorRange; 1 is full. Without either, RGB is full and others limited."""
    for name in ("_Range", "_ColorRange"):
        if props and props.get(name) is not None:
            return props[name] == 1
    return rgb


def is_full_range_column(props: Column, rgb: bool) -> Column:
    said = F.coalesce(F.try_element_at(props, F.lit("_Range")), F.try_element_at(props, F.lit("_ColorRange")))
    return F.coalesce(said == 1, F.lit(rgb))
