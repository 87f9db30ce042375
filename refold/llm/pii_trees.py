"""Boosted trees for PII candidates, fitted on the driver over a bounded, seeded training set.

No table has labels for single spans, so the training rows are drawn from a rule: for each kind,
well-formed and broken specimens with and without telling context, described by the same features
that the corpus expressions compute. At most MAX_ROWS rows are drawn; the fit is deterministic.
Half of the rows fit the trees, the other half calibrate: scores are turned into precision by
pooling adjacent violators, and the threshold is the lowest score whose precision reaches the goal.
"""

from __future__ import annotations

import functools
import random

import numpy as np

MAX_ROWS = 4000
ROUNDS, DEPTH, RATE, GOAL = 24, 3, 0.4, 0.98
FEATURES = ("kind", "digits", "seps", "luhn", "led", "cue", "glued", "parts_ok")
KINDS = ("email", "ip", "card", "phone")


def _draw(n: int = MAX_ROWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Rows of FEATURES and whether each is personal data.

    kind: index in KINDS; digits: how many; seps: separators inside; luhn: checksum holds; led:
    a leading + or 00, or brackets round an area code; cue: a telling word before; glued: a letter
    or digit touches the span; parts_ok: the groups have the sizes that the kind is written in.
    """
    r, rows, truth = random.Random(seed), [], []
    for i in range(n):
        kind, cue, glued = i % 4, r.random() < 0.35, r.random() < 0.2
        if kind == 0:
            digits, seps, luhn, led = r.randrange(0, 6), r.randrange(1, 5), False, False
            ok = r.random() < 0.6
            true = ok and not glued
        elif kind == 1:
            digits, seps, luhn, led = r.randrange(4, 13), 3, False, False
            ok = r.random() < 0.6
            true = ok and (cue or not glued)
        elif kind == 2:
            digits, seps = r.choice((13, 14, 15, 16, 16, 16, 16, 19)), r.choice((0, 0, 3, 3, r.randrange(0, 9)))
            luhn, led, ok = r.random() < 0.6, False, r.random() < 0.8
            true = luhn and not glued and (ok or cue)
        else:
            digits, seps = r.randrange(7, 16), r.randrange(0, 7)
            luhn, led, ok = r.random() < 0.2, r.random() < 0.5, r.random() < 0.6
            true = not glued and 9 <= digits <= 15 and ok and (led or cue)
        rows.append((kind, digits, seps, luhn, led, cue, glued, ok))
        truth.append(true if r.random() > 0.01 else not true)
    return np.array(rows, float), np.array(truth, float)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A node: (feature, cut, left, right), or the leaf's value by Newton's step."""
    leaf = float(g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 16:
        return leaf
    best = (1e-6, None)
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        gain = gs[at] ** 2 / (hs[at] + 1) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1) - base
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), (f, float((v[at[k]] + v[at[k] + 1]) / 2)))
    if best[1] is None:
        return leaf
    f, cut = best[1]
    left = x[:, f] < cut
    return (f, cut, _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1))


def score(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    f, cut, left, right = node
    return np.where(x[:, f] < cut, score(left, x), score(right, x))


@functools.lru_cache(1)
def fitted() -> tuple[tuple, float]:
    """(trees, threshold on the sum of their leaves)."""
    x, y = _draw()
    fit = np.arange(len(y)) // 4 % 2 == 0  # the kind is i % 4: both halves hold every kind
    total, trees = np.zeros(len(y)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total[fit]))
        tree = _grow(x[fit], y[fit] - p, p * (1 - p), DEPTH)
        trees.append(tree)
        total += RATE * score(tree, x)
    return tuple(trees), _calibrated(total[~fit] / RATE, y[~fit])


def _calibrated(s: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(s, kind="stable")
    blocks: list[list[float]] = []  # sum of truth, rows, lowest score
    for v, t in zip(s[order], y[order], strict=True):
        blocks.append([t, 1.0, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, _ = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += n2
    good = [b[2] for b in blocks if b[0] / b[1] >= GOAL]
    return min(good) if good else float("inf")
