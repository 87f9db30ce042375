"""Where a sample outside a signal is taken from: NumPy and Column forms of five border rules.

zero: nowhere (-1). repeat: the edge sample. reflect101: mirrored about the edge sample, again and
again. symmetric: mirrored about the edge, again and again. mirror: mirrored about the edge once,
beyond that nowhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BORDERS = ("zero", "repeat", "reflect101", "symmetric", "mirror")
#: Numbers of the public API.
PADDING = {0: "zero", 1: "repeat", 2: "reflect101", 3: "symmetric"}
BORDER_HANDLING = {0: "mirror", 1: "zero", 2: "repeat"}


def index(i: np.ndarray, size: int, border: str) -> np.ndarray:
    """Places in 0..size-1 for whole numbers i, -1 for nowhere."""
    if size <= 0:
        raise ValueError("padding size must be positive")
    if border not in BORDERS:
        raise ValueError("padding mode is invalid")
    i = np.asarray(i, np.int64)
    if border == "repeat":
        return np.clip(i, 0, size - 1)
    inside = (i >= 0) & (i < size)
    if border == "zero":
        return np.where(inside, i, -1)
    if border == "mirror":
        folded = np.where(i < 0, -1 - i, 2 * size - 1 - i)
        return np.where(inside, i, np.where((folded >= 0) & (folded < size), folded, -1))
    turn = 1 if border == "reflect101" else 0  # samples that the two directions share
    period = max(1, 2 * (size - turn))
    m = np.mod(i, period)
    return np.minimum(m, np.where(m < size, m, period - 1 + turn - m))


def column(i: Column, size: Column | int, border: str) -> Column:
    """The same as an expression; size may be a column."""
    n = F.lit(size) if isinstance(size, int) else size
    inside = (i >= 0) & (i < n)
    if border == "repeat":
        return F.greatest(F.lit(0), F.least(i, n - 1))
    if border == "zero":
        return F.when(inside, i).otherwise(-1)
    if border == "mirror":
        folded = F.when(i < 0, -1 - i).otherwise(2 * n - 1 - i)
        return F.when(inside, i).when(folded.between(F.lit(0), n - 1), folded).otherwise(-1)
    if border not in BORDERS:
        raise ValueError("padding mode is invalid")
    turn = 1 if border == "reflect101" else 0
    period = F.greatest(F.lit(1), 2 * (n - turn))
    m = F.pmod(i, period)
    return F.when(m < n, m).otherwise(period - 1 + turn - m)
