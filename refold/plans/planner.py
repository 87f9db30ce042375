"""Least-squares plans for many requests at once.

A request's interpolation is a sparse matrix A (a few taps for each source sample). The plan holds
the banded normal matrix's LDL' factors. Factoring is sequential along the axis, so plans of equal
bandwidth are factored side by side: one NumPy step along the axis serves all of them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from refold.functions import borders
from refold.functions.numbers import round_half_up

from .requests import Request

EPS = float(np.finfo(np.float64).eps)
#: Below this reciprocal condition a plan in mode auto is solved in double precision.
SAFE = 1.0e-4


@dataclass
class Plan:
    """sources, weights: for each destination sample the source samples it touches (padded, weight 0),
    in ascending order; places, shares: for each source sample the destination samples. bands: the normal matrix by distance from the diagonal. factors: L below a
    unit diagonal, D in row 0."""

    request: Request
    sources: np.ndarray
    weights: np.ndarray
    places: np.ndarray
    shares: np.ndarray
    bands: np.ndarray
    factors: np.ndarray
    rcond: float
    one_norm: float
    double: bool
    narrow: dict = field(default_factory=dict)

    @property
    def half_bandwidth(self) -> int:
        return len(self.bands) - 1

    def single(self) -> dict:
        """Coefficients in single precision: made in double, then narrowed once."""
        if not self.narrow:
            f, n, hb = self.factors, self.factors.shape[1], self.half_bandwidth
            low = np.zeros((n, hb))  # low[i, hb - d] = L[i, i - d] * D[i - d], beside samples i - hb..i - 1
            up = np.zeros((n, hb))  # up[i, d - 1] = L[i + d, i], beside samples i + 1..i + hb
            for d in range(1, hb + 1):
                low[d:, hb - d] = f[d, : n - d] * f[0, : n - d]
                up[: n - d, d - 1] = f[d, : n - d]
            self.narrow = {"low": low.astype(np.float32), "up": up.astype(np.float32), "inverse": (1.0 / (f[0] + EPS)).astype(np.float32), "weights": self.weights.astype(np.float32)}
        return self.narrow


def taps(r: Request) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(destination place or -1, signed distance, normalised weight), each source_size x taps. Weights
    are shares of all taps, those that the border drops included."""
    n = 2 * r.kernel.support
    position = (np.arange(r.source_size) + 0.5) / (r.source_size / r.active_length) + r.shift
    first = round_half_up(position - r.kernel.support) + 0.5
    centre = first[:, None] + np.arange(n)
    distance = centre - position[:, None]
    weight = r.kernel.weights(distance)
    total = np.zeros(r.source_size)
    for k in range(n):  # in the order of the taps
        total = total + weight[:, k]
    if not np.isfinite(weight).all():
        raise ValueError("filter returned a non-finite value")
    if not np.isfinite(total).all() or (total == 0).any():
        raise ValueError("filter produced a zero or non-finite weight sum")
    return borders.index(np.floor(centre).astype(np.int64), r.destination_size, r.border), distance, weight / total[:, None]


def coo(r: Request) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A as (source, destination, weight), sorted; taps on one place are added up, zeros left out."""
    place, _, weight = taps(r)
    src = np.repeat(np.arange(r.source_size), place.shape[1])
    place, weight = place.ravel(), weight.ravel()
    ok = (place >= 0) & (weight != 0)
    key, slot = np.unique(src[ok] * r.destination_size + place[ok], return_inverse=True)
    total = np.zeros(len(key))
    np.add.at(total, slot, weight[ok])
    return key // r.destination_size, key % r.destination_size, total


def normal_bands(r: Request, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A'A by distance from the diagonal: bands[d, i] = sum over source samples of A[., i] A[., i + d]."""
    hb, n = r.half_bandwidth, r.destination_size
    bands = np.zeros((hb + 1, n))
    for step in range(int(np.bincount(src).max(initial=0))):
        # entries `step` apart in the sorted list belong together where the source sample is the same
        same = src[step:] == src[: len(src) - step]
        a, b = np.flatnonzero(same), np.flatnonzero(same) + step
        np.add.at(bands, (dst[b] - dst[a], dst[a]), w[a] * w[b])
    return bands


def build(requests: Iterable[Request]) -> list[Plan]:
    """Plans in the order of the requests; equal requests share one."""
    requests = list(requests)
    distinct = {r.key: r for r in requests}
    by_width: dict[int, list[Request]] = {}
    for r in distinct.values():
        by_width.setdefault(r.half_bandwidth, []).append(r)
    done = {}
    for group in by_width.values():
        done |= {r.key: p for r, p in zip(group, _build(group), strict=True)}
    return [done[r.key] for r in requests]


def _build(group: list[Request]) -> list[Plan]:
    sparse = [coo(r) for r in group]
    each = [normal_bands(r, *s) for r, s in zip(group, sparse, strict=True)]
    n = np.array([r.destination_size for r in group])
    width = int(n.max())
    bands = np.zeros((len(group), len(each[0]), width))
    bands[:, 0, :] = 1.0  # padding beyond a shorter axis
    for k, b in enumerate(each):
        bands[k, :, : n[k]] = b
    factors = factor(bands)
    rcond, norm = condition(bands, factors, n)
    out = []
    for k, r in enumerate(group):
        src, dst, w = sparse[k]
        views = *_padded(dst, src, w, r.destination_size), *_padded(src, dst, w, r.source_size)
        double = r.mode == "f64" or r.mode == "auto" and rcond[k] < SAFE
        out.append(Plan(r, *views, each[k], factors[k, :, : n[k]].copy(), float(rcond[k]), float(norm[k]), double))
    return out


def _padded(by: np.ndarray, other: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries as rows 0..n - 1 of equal width: the other index and the weight, 0 where a row is shorter."""
    order = np.argsort(by, kind="stable")
    count = np.bincount(by, minlength=n)
    slot = np.arange(len(by)) - np.repeat(np.cumsum(count) - count, count)
    index = np.zeros((n, max(1, int(count.max(initial=0)))), np.int64)
    weight = np.zeros(index.shape)
    index[by[order], slot], weight[by[order], slot] = other[order], w[order]
    return index, weight


def factor(bands: np.ndarray) -> np.ndarray:
    """LDL' of stacked banded matrices (plan, distance, place). A pivot is D + EPS; D itself is kept."""
    f = bands.copy()
    hb, n = f.shape[1] - 1, f.shape[2]
    for i in range(n):
        m = min(hb, n - 1 - i)
        if m:
            column = f[:, 1 : m + 1, i].copy()
            ratio = column / (f[:, 0, i] + EPS)[:, None]
            for d in range(1, m + 1):
                f[:, : m - d + 1, i + d] -= ratio[:, d - 1, None] * column[:, d - 1 :]
            f[:, 1 : m + 1, i] = column * (1.0 / (f[:, 0, i] + EPS))[:, None]
    return f


def solve(factors: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Stacked solutions (plan, place) with stacked factors, in double precision."""
    x, (_, bands, n) = rhs.copy(), factors.shape
    for i in range(n):
        for d in range(min(bands - 1, i), 0, -1):
            x[:, i] -= factors[:, d, i - d] * x[:, i - d]
    x /= factors[:, 0] + EPS
    for i in range(n - 2, -1, -1):
        for d in range(min(bands - 1, n - 1 - i), 0, -1):
            x[:, i] -= factors[:, d, i] * x[:, i + d]
    return x


def condition(bands: np.ndarray, factors: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(reciprocal condition, 1-norm) of each. Two cheap lower bounds settle what is clearly safe; for
    the rest the norm of the inverse is estimated."""
    inside = np.arange(bands.shape[2]) < n[:, None]
    size, hb = np.abs(bands), bands.shape[1] - 1
    sums = size[:, 0].copy()
    for d in range(1, hb + 1):
        sums += size[:, d]
        sums[:, d:] += size[:, d, : bands.shape[2] - d]
    norm = np.where(inside, sums, 0).max(1)
    margin = np.where(inside, 2 * size[:, 0] - sums, np.inf).min(1)
    with np.errstate(all="ignore"):
        rcond = np.where((margin > 0) & (norm > 0), margin / norm, 0.0)
        for estimate in (_comparison, _inverse_norm):
            open_ = np.flatnonzero(rcond < SAFE)
            if len(open_):
                inverse = estimate(factors[open_], inside[open_])
                r = 1 / (norm[open_] * inverse)
                rcond[open_] = np.where((norm[open_] > 0) & (inverse > 0) & np.isfinite(norm[open_]) & np.isfinite(inverse), np.clip(r, 0, 1), 0.0)
    return rcond, norm


def _comparison(f: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A bound on the inverse's norm from |L|, whose comparison matrix is inverted on a vector of ones."""
    size, (_, bands, n) = np.abs(f), f.shape
    rows, columns = np.ones(inside.shape), np.ones(inside.shape)
    for i in range(n):
        for d in range(1, min(bands - 1, i) + 1):
            rows[:, i] += size[:, d, i - d] * rows[:, i - d]
    for i in range(n - 1, -1, -1):
        for d in range(1, min(bands - 1, n - 1 - i) + 1):
            columns[:, i] += size[:, d, i] * columns[:, i + d]
    top = lambda v: np.where(inside, v, 0).max(1)
    return top(columns) * top(1 / np.abs(f[:, 0] + EPS)) * top(rows)


def _inverse_norm(f: np.ndarray, inside: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Hager's estimate of the inverse's 1-norm, all plans at once; a plan that has settled rests."""
    x = inside / inside.sum(1, keepdims=True)
    best, last, live = np.zeros(len(f)), np.full(len(f), -1), np.arange(len(f))
    for _ in range(rounds):
        y = solve(f[live], x[live])
        best[live] = np.maximum(best[live], np.abs(np.where(inside[live], y, 0)).sum(1))
        z = solve(f[live], np.where(inside[live], np.where(y < 0, -1.0, 1.0), 0.0))
        z = np.where(inside[live], z, 0)
        k = np.abs(z).argmax(1)
        go = (k != last[live]) & (np.abs(z[np.arange(len(k)), k]) > (z * x[live]).sum(1))
        live, k = live[go], k[go]
        if not len(live):
            break
        last[live] = k
        x[live] = 0
        x[live, k] = 1
    return best
