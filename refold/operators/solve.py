"""Solving plans for blocks of signals: lanes side by side, one step along the axis for all."""

from __future__ import annotations

import numpy as np

from refold.plans.planner import EPS, SAFE, Plan


#: Values of a block of rows that stay in a core's cache while they are summed.
BLOCK = 1 << 16


def _gather(index: np.ndarray, weights: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of index the weighted sum of y's rows, in the order of its columns."""
    n, lanes = len(index), y.shape[1]
    out = np.empty((n, lanes), np.result_type(weights, y))
    step = max(1, BLOCK // max(1, lanes))
    part = np.empty((min(step, n), lanes), out.dtype)
    for at in range(0, n, step):
        rows, w = index[at : at + step], weights[at : at + step]
        total, term = out[at : at + step], part[: len(rows)]
        np.multiply(w[:, :1], y[rows[:, 0]], out=total)
        for k in range(1, weights.shape[1]):
            np.multiply(w[:, k : k + 1], y[rows[:, k]], out=term)
            total += term
    return out


def inverse(plan: Plan, y: np.ndarray) -> np.ndarray:
    """The samples (destination, lane) whose interpolation comes closest to y (source, lane), in the
    plan's precision: double if the plan asks for it, else single. Double rejects NaN and infinity."""
    if len(y) != plan.request.source_size:
        raise ValueError(f"expected {plan.request.source_size} samples, got {len(y)}")
    return inverse_double(plan, y) if plan.double else inverse_single(plan, y)


#: Samples of the axis that one matrix product solves.
ROWS = 64


def blocks(plan: Plan) -> list[tuple]:
    """The single-precision recurrences in steps of ROWS samples: for samples a..b - 1 (a, b, first and
    end of their sources, the products of the forward step with sources and with what is carried in, those of
    the backward step). Triangles are inverted in double and narrowed once."""
    if "blocks" not in plan.narrow:
        plan.single()
        f, n, hb, out = plan.factors, plan.factors.shape[1], plan.half_bandwidth, []
        lower = lambda d, i: f[d, i - d] * f[0, i - d]
        for a in range(0, n, ROWS):
            b = min(n, a + ROWS)
            used = plan.sources[a:b][plan.weights[a:b] != 0]
            lo, hi = (int(used.min()), int(used.max()) + 1) if used.size else (0, 1)
            matrix = np.zeros((b - a, hi - lo))
            rows, slots = np.nonzero(plan.weights[a:b])
            np.add.at(matrix, (rows, plan.sources[a:b][rows, slots] - lo), plan.weights[a:b][rows, slots])
            down, up = np.diag(f[0, a:b] + EPS), np.eye(b - a)
            before, after = np.zeros((b - a, min(hb, a))), np.zeros((b - a, min(hb, n - b)))
            for d in range(1, hb + 1):
                i = np.arange(max(a, d), b)
                inside, outside = i[i - d >= a], i[i - d < a]
                down[inside - a, inside - d - a] = lower(d, inside)
                before[outside - a, outside - d - a + before.shape[1]] = lower(d, outside)
                i = np.arange(a, min(b, n - d))
                inside, outside = i[i + d < b], i[i + d >= b]
                up[inside - a, inside + d - a] = f[d, inside]
                after[outside - a, outside + d - b] = f[d, outside]
            down, up = np.linalg.inv(down), np.linalg.inv(up)
            out.append((a, b, lo, hi, *(m.astype(np.float32) for m in (down @ matrix, -down @ before, up, -up @ after))))
        plan.narrow["blocks"] = out
    return plan.narrow["blocks"]


def inverse_single(plan: Plan, y: np.ndarray, across: bool = False) -> np.ndarray:
    """Single precision, along the first axis, or across: along the second."""
    if plan.rcond < SAFE:  # ill-conditioned and asked for all the same: sample by sample
        return np.ascontiguousarray(_stepped(plan, np.ascontiguousarray(y.T)).T) if across else _stepped(plan, y)
    y = np.asarray(y, np.float32)
    n, steps = plan.factors.shape[1], blocks(plan)
    x = np.empty((len(y), n) if across else (n, y.shape[1]), np.float32)
    for a, b, lo, hi, own, carried, _, _ in steps:
        k = carried.shape[1]
        if across:
            np.matmul(y[:, lo:hi], own.T, out=x[:, a:b])
            if k:
                x[:, a:b] += x[:, a - k : a] @ carried.T
        else:
            np.matmul(own, y[lo:hi], out=x[a:b])
            if k:
                x[a:b] += carried @ x[a - k : a]
    for a, b, _, _, _, _, own, carried in reversed(steps):
        k = carried.shape[1]
        if across:
            part = x[:, a:b] @ own.T
            x[:, a:b] = part + x[:, b : b + k] @ carried.T if k else part
        else:
            part = own @ x[a:b]
            x[a:b] = part + carried @ x[b : b + k] if k else part
    return x


def _stepped(plan: Plan, y: np.ndarray) -> np.ndarray:
    s, hb = plan.single(), plan.half_bandwidth
    x = _gather(plan.sources, s["weights"], np.asarray(y, np.float32))
    n, low, up, scale = len(x), s["low"], s["up"], s["inverse"]
    for i in range(n):
        k = min(hb, i)
        if k:
            x[i] -= low[i, hb - k :] @ x[i - k : i]
        x[i] *= scale[i]
    for i in range(n - 2, -1, -1):
        k = min(hb, n - 1 - i)
        if k:
            x[i] -= up[i, :k] @ x[i + 1 : i + 1 + k]
    return x


def inverse_double(plan: Plan, y: np.ndarray) -> np.ndarray:
    y = np.asarray(y, np.float64)
    if not np.isfinite(y).all():
        raise ValueError("f64 input contains a non-finite sample")
    x, f, hb = _gather(plan.sources, plan.weights, y), plan.factors, plan.half_bandwidth
    n = len(x)
    back = np.zeros((n, hb))
    ahead = np.zeros((n, hb))
    for d in range(1, hb + 1):
        back[d:, hb - d] = f[d, : n - d]
        ahead[: n - d, d - 1] = f[d, : n - d]
    for i in range(1, n):
        k = min(hb, i)
        x[i] -= back[i, hb - k :] @ x[i - k : i]
    x /= (f[0] + EPS)[:, None]
    for i in range(n - 2, -1, -1):
        k = min(hb, n - 1 - i)
        x[i] -= ahead[i, :k] @ x[i + 1 : i + 1 + k]
    if not np.isfinite(x).all():
        raise ValueError("f64 result contains a non-finite sample")
    return x


def forward(plan: Plan, x: np.ndarray) -> np.ndarray:
    """A x: the interpolation itself, from (destination, lane) to (source, lane)."""
    kind = np.float64 if x.dtype == np.float64 else np.float32
    return _gather(plan.places, plan.shares.astype(kind), x.astype(kind, copy=False))


def inverse_2d(h: Plan | None, v: Plan | None, plane: np.ndarray) -> np.ndarray:
    """Rows, then columns, of a plane (height, width). If either axis is double, both are, with the
    plane between them in double; the result is single precision."""
    double = bool(h and h.double or v and v.double)
    step = inverse_double if double else inverse_single
    x = np.asarray(plane, np.float64 if double else np.float32)
    if h:
        x = step(h, x.T).T
    if v:
        x = step(v, x)
    return np.ascontiguousarray(x, np.float32)


def inverse_codes(h: Plan | None, v: Plan | None, codes: np.ndarray, given, wanted=None) -> np.ndarray:
    """The same for whole-number samples: decoded by the given range, encoded by the wanted one."""
    double = bool(h and h.double or v and v.double)
    x = given.decode(codes, np.float64 if double else np.float32)
    step = inverse_double if double else inverse_single
    if h:
        x = step(h, x.T).T
    if v:
        x = step(v, x)
    return (wanted or given).encode(np.asarray(x)).astype(np.int32)


def inverse_partitioned(plan: Plan, y: np.ndarray, chunks: int) -> np.ndarray:
    """The double-precision solution with the axis cut into 2..32 chunks of at least 32 samples.

    A chunk's recurrence is linear in the samples carried into it: it is run once for its own right side
    and once for each unit carry, all chunks side by side. Then the carries are passed along the chunks, and
    each chunk adds what its carry brings. So the steps in a row are those of one chunk, not of the axis.
    """
    x, f, hb = _gather(plan.sources, plan.weights, np.asarray(y, np.float64)), plan.factors, plan.half_bandwidth
    n = len(x)
    chunks = max(1, min(chunks, 32, n // max(32, hb)))
    if chunks < 2 or hb == 0:
        return inverse_double(plan, y)
    back = np.zeros((n, hb))
    ahead = np.zeros((n, hb))
    for d in range(1, hb + 1):
        back[d:, hb - d] = f[d, : n - d]
        ahead[: n - d, d - 1] = f[d, : n - d]
    x = _recur(back, x, chunks)
    x /= (f[0] + EPS)[:, None]
    # from the far end the other way: the same recurrence on reversed places
    return _recur(ahead[::-1, ::-1], x[::-1], chunks)[::-1]


def _recur(c: np.ndarray, r: np.ndarray, chunks: int) -> np.ndarray:
    """x[i] = r[i] - c[i] . x[i - hb .. i - 1], with zeros before the first."""
    (n, hb), lanes = c.shape, r.shape[1]
    size = -(-n // chunks)
    pad = chunks * size - n
    cs = np.pad(c, ((0, pad), (0, 0))).reshape(chunks, size, hb)
    own = np.concatenate([np.pad(r, ((0, pad), (0, 0))).reshape(chunks, size, lanes), np.zeros((chunks, size, hb))], axis=2)
    run = np.zeros((chunks, hb + size, lanes + hb))
    run[:, :hb, lanes:] = np.eye(hb)  # the last columns answer to each unit carry
    for i in range(size):
        run[:, hb + i] = own[:, i] - np.einsum("kb,kbl->kl", cs[:, i], run[:, i : i + hb])
    carry, out = np.zeros((hb, lanes)), []
    for k in range(chunks):
        whole = run[k, :, :lanes] + run[k, :, lanes:] @ carry
        out.append(whole[hb:])
        carry = whole[-hb:]
    return np.concatenate(out)[:n]
