"""A bounded memo of plans for calls that come one by one, with counters; and what this engine can run on.

Equal requests share a plan by their canonical key. Custom kernels are not kept: a function may change
what it returns. One build serves all threads that wait for it."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Iterable

from .planner import Plan, build
from .requests import Request

ENTRIES, BYTES = 2048, 256 << 20


def size(plan: Plan) -> int:
    return sum(x.nbytes for x in (plan.sources, plan.weights, plan.places, plan.shares, plan.bands, plan.factors))


class PlanCache:
    def __init__(self, entries: int = ENTRIES, limit: int = BYTES):
        self.entries, self.limit, self.lock = entries, limit, threading.RLock()
        self.clear()

    def clear(self) -> None:
        with self.lock:
            self.plans: OrderedDict[tuple, Plan] = OrderedDict()
            self.bytes = self.hits = self.builds = 0

    def get(self, requests: Iterable[Request]) -> list[Plan]:
        """Plans in the order of the requests; those that are missing are built side by side."""
        requests = list(requests)
        with self.lock:
            missing = {r.key: r for r in requests if r.key not in self.plans}
            self.hits += sum(r.key in self.plans for r in requests)
            self.builds += len(missing)
            new = dict(zip(missing, build(missing.values()), strict=True))
            out = [new.get(r.key) or self.plans[r.key] for r in requests]
            for r, p in zip(requests, out, strict=True):
                if r.kernel.kind != "custom":
                    self.bytes += 0 if r.key in self.plans else size(p)
                    self.plans[r.key] = p
                    self.plans.move_to_end(r.key)
            while self.plans and (len(self.plans) > self.entries or self.bytes > self.limit):
                self.bytes -= size(self.plans.popitem(last=False)[1])
            return out

    def statistics(self) -> dict[str, int]:
        with self.lock:
            return {"hits": self.hits, "builds": self.builds, "entries": len(self.plans), "bytes": self.bytes}


PLANS = PlanCache()


def capabilities() -> dict[str, dict[str, bool]]:
    """Back ends by name: whether this build knows them and whether they run here."""
    return {"auto": {"compiled": True, "available": True}, "cpu": {"compiled": True, "available": True}}


def check(plan: Plan) -> None:
    """Raises unless a plan is whole: sizes agree, places lie inside, coefficients are finite."""
    import numpy as np

    r = plan.request
    whole = plan.bands.shape == plan.factors.shape == (r.half_bandwidth + 1, r.destination_size) and len(plan.sources) == r.destination_size and len(plan.places) == r.source_size
    inside = plan.sources.min() >= 0 and plan.sources.max() < r.source_size and plan.places.min() >= 0 and plan.places.max() < r.destination_size
    if not (whole and inside and all(np.isfinite(x).all() for x in (plan.weights, plan.shares, plan.bands, plan.factors))):
        raise ValueError("failed to build inverse axis plan")
