"""Interpolation kernels: a NumPy form for plans, and a Column form for queries.

Every kernel is a piecewise cubic in the distance, or a windowed sinc. The cubics are held as one
table of pieces, so that both forms evaluate the same numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, isfinite

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of 1, x, x^2, x^3 on [k, k + 1), in x - k.
SPLINES = {
    "spline16": (
        (1.0, -1 / 5, -9 / 5, 1.0),
        (0.0, -7 / 15, 4 / 5, -1 / 3),
    ),
    "spline36": (
        (1.0, -3 / 209, -453 / 209, 13 / 11),
        (0.0, -156 / 209, 270 / 209, -6 / 11),
        (0.0, 26 / 209, -45 / 209, 1 / 11),
    ),
    "spline64": (
        (1.0, -3 / 2911, -6387 / 2911, 49 / 41),
        (0.0, -2328 / 2911, 4032 / 2911, -24 / 41),
        (0.0, 582 / 2911, -1008 / 2911, 6 / 41),
        (0.0, -97 / 2911, 168 / 2911, -1 / 41),
    ),
}
KINDS = ("bilinear", "bicubic", "lanczos", "spline16", "spline36", "spline64", "custom")


@dataclass(frozen=True)
class Kernel:
    """kind; taps for lanczos and custom, b and c for bicubic, blur for all. weight: for custom, a
    function of the absolute distance."""

    kind: str
    taps: int = 3
    b: float = 0.0
    c: float = 0.5
    blur: float = 1.0
    weight: object = None

    def __post_init__(self):
        object.__setattr__(self, "kind", self.kind.lower())
        if self.kind not in KINDS:
            raise ValueError(f"unknown kernel: {self.kind}")
        if not (self.blur > 0 and isfinite(self.blur)):
            raise ValueError("blur must be finite and greater than zero")
        if self.kind in ("lanczos", "custom") and self.taps < 1:
            raise ValueError("taps must be at least 1")
        if self.kind == "custom" and not callable(self.weight):
            raise ValueError("a custom kernel needs a callable")

    @property
    def base_support(self) -> int:
        if self.kind in ("lanczos", "custom"):
            return self.taps
        return {"bilinear": 1, "bicubic": 2}.get(self.kind) or len(SPLINES[self.kind])

    @property
    def support(self) -> int:
        return ceil(self.base_support * self.blur)

    @property
    def name(self) -> str:
        if self.kind == "bicubic":
            return f"bicubic_b{self.b:.1f}_c{self.c:.1f}"
        return f"lanczos{self.taps}" if self.kind == "lanczos" else self.kind

    @property
    def key(self) -> tuple:
        """Equal for kernels that give the same weights; parameters that a kind ignores don't count."""
        if self.kind == "custom":
            return ("custom", id(self.weight), self.taps, self.blur)
        taps = self.taps if self.kind == "lanczos" else 0
        b, c = (self.b, self.c) if self.kind == "bicubic" else (0.0, 0.0)
        return (self.kind, taps, b, c, self.blur)

    def pieces(self) -> tuple:
        """The table of cubics (None for windowed sinc and custom)."""
        if self.kind == "bilinear":
            return ((1.0, -1.0, 0.0, 0.0),)
        if self.kind == "bicubic":
            b, c = self.b, self.c
            # the two-parameter cubic family; the outer piece is written in x - 1 as well
            inner = ((6 - 2 * b) / 6, 0.0, (-18 + 12 * b + 6 * c) / 6, (12 - 9 * b - 6 * c) / 6)
            k0, k1, k2, k3 = (8 * b + 24 * c) / 6, (-12 * b - 48 * c) / 6, (6 * b + 30 * c) / 6, (-b - 6 * c) / 6
            return (inner, (k0 + k1 + k2 + k3, k1 + 2 * k2 + 3 * k3, k2 + 3 * k3, k3))
        return SPLINES.get(self.kind)

    def weights(self, distance: np.ndarray) -> np.ndarray:
        """Weights of signed distances, blur included."""
        x = np.abs(distance if self.blur == 1.0 else distance / self.blur)
        if self.kind == "custom":
            return np.vectorize(self.weight, otypes=[float])(x)
        if self.kind == "lanczos":
            return np.where(x < self.taps, np.sinc(x) * np.sinc(x / self.taps), 0.0)
        table = np.array(self.pieces())
        k = np.minimum(np.floor(x).astype(np.int64), len(table) - 1)
        p, t = table[k], x - k
        return np.where(x < len(table), p[..., 0] + t * (p[..., 1] + t * (p[..., 2] + t * p[..., 3])), 0.0)

    def column(self, distance: Column) -> Column:
        """The same as an expression."""
        if self.kind == "custom":
            raise ValueError("a custom kernel has no column form")
        x = F.abs(distance if self.blur == 1.0 else distance / self.blur)
        if self.kind == "lanczos":
            sinc = lambda v: F.when(v == 0, 1.0).otherwise(F.sin(F.pi() * v) / (F.pi() * F.when(v != 0, v)))
            return F.when(x < self.taps, sinc(x) * sinc(x / self.taps)).otherwise(0.0)
        out = F.lit(0.0)
        for k, (a, b, c, d) in reversed(list(enumerate(self.pieces()))):
            t = x - k
            out = F.when(x < k + 1, F.lit(a) + t * (F.lit(b) + t * (F.lit(c) + t * F.lit(d)))).otherwise(out)
        return out
