"""Digests and bit-level distances that Spark has no function for, over Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# The stable hash's basis and prime.
BASIS, PRIME = 1469598103934665603, 1099511628211
_MASK = (1 << 64) - 1


def stable_hash(data: bytes, basis: int = BASIS) -> int:
    h = basis
    for byte in data:
        h = (h ^ byte) * PRIME & _MASK
    return h


@pandas_udf(T.StringType())
def stable_hash_hex(text: pd.Series) -> pd.Series:
    """16 hex digits of the hash of the length (8 bytes, little-endian) and the UTF-8 bytes."""
    return text.map(lambda t: None if t is None else f"{stable_hash(len(b := t.encode()).to_bytes(8, 'little') + b):016x}")


@pandas_udf(T.StringType())
def samples_sha256(samples: pd.Series) -> pd.Series:
    """Hex SHA-256 of arrays of samples as little-endian single precision; null for null."""
    return samples.map(lambda x: None if x is None else hashlib.sha256(np.asarray(x, "<f4").tobytes()).hexdigest())


def ulp_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Representable single-precision numbers between a and b; the zeros are one."""

    def ordered(x):
        bits = np.asarray(x, np.float32).view(np.int32).astype(np.int64)
        return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits)

    return np.abs(ordered(a) - ordered(b))


@pandas_udf(T.LongType())
def ulps(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ulp_distance(a.to_numpy(np.float32), b.to_numpy(np.float32)))


def xorshift32(n: int, seed: int) -> np.ndarray:
    """n states after the seed."""
    out, s = np.empty(n, np.uint32), seed
    for k in range(n):
        s = (s ^ s << 13) & 0xFFFFFFFF
        s ^= s >> 17
        s = (s ^ s << 5) & 0xFFFFFFFF
        out[k] = s
    return out
