"""Kernels, borders, plans and solutions against dense linear algebra and published values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from refold.functions import borders, digests
from refold.functions.kernels import KINDS, Kernel
from refold.functions.numbers import is_full_range, round_half_up, round_half_up_column, sample_range
from refold.operators import solve
from refold.plans import planner, relational
from refold.plans.requests import Request, axis

PLACES = {
    "zero": [-1] * 8 + [0, 1, 2, 3] + [-1] * 8,
    "repeat": [0] * 8 + [0, 1, 2, 3] + [3] * 8,
    "reflect101": [2, 1, 0, 1, 2, 3, 2, 1, 0, 1, 2, 3, 2, 1, 0, 1, 2, 3, 2, 1],
    "symmetric": [0, 1, 2, 3, 3, 2, 1, 0, 0, 1, 2, 3, 3, 2, 1, 0, 0, 1, 2, 3],
    "mirror": [-1] * 4 + [3, 2, 1, 0, 0, 1, 2, 3, 3, 2, 1, 0] + [-1] * 4,
}
FIXTURES = [
    (axis(41, 35, Kernel("bilinear"), 35, 0.1875, "symmetric", "f32"), 1),
    (axis(47, 39, Kernel("bicubic"), 39, -0.3125, "reflect101", "f32"), 3),
    (axis(59, 49, Kernel("lanczos", 3), 49, 0.4375, "repeat", "f32"), 5),
    (axis(67, 57, Kernel("spline64"), 57, -0.25, "zero", "f32"), 7),
    (axis(73, 61, Kernel("bicubic"), 60.5, 0.125, "symmetric", "f64"), 3),
    (axis(17, 13, Kernel("bicubic"), 12.75, 0.125, "symmetric", "f32"), 3),
    (axis(9, 9, Kernel("spline16"), 9, 0.5, "mirror", "auto"), 3),
    (axis(5, 1, Kernel("bilinear"), 1, 0.0, "repeat", "auto"), 0),
]
KERNELS = [Kernel("bilinear"), Kernel("bicubic"), Kernel("bicubic", b=1 / 3, c=1 / 3), Kernel("lanczos", 2), Kernel("lanczos", 4), Kernel("spline16"), Kernel("spline36"), Kernel("spline64")]


def dense(r):
    src, dst, w = planner.coo(r)
    a = np.zeros((r.source_size, r.destination_size))
    a[src, dst] = w
    return a


@pytest.mark.parametrize("border", borders.BORDERS)
def test_borders(spark, border):
    i = np.arange(-8, 12)
    assert borders.index(i, 4, border).tolist() == PLACES[border]
    rows = spark.range(20).select(borders.column(F.col("id") - 8, 4, border).alias("p")).collect()
    assert [r.p for r in rows] == PLACES[border]
    if border in ("repeat", "reflect101", "symmetric"):
        assert set(borders.index(i, 1, border).tolist()) == {0}


def test_borders_reject():
    with pytest.raises(ValueError, match="positive"):
        borders.index(np.zeros(1), 0, "zero")
    with pytest.raises(ValueError, match="invalid"):
        borders.index(np.zeros(1), 3, "wrap")


@pytest.mark.parametrize("kernel", KERNELS, ids=lambda k: k.name)
def test_kernels_sum_to_one_and_columns_agree(spark, kernel):
    x = np.linspace(-5, 5, 401)
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").select(kernel.column(F.col("x")).alias("w")).collect()
    np.testing.assert_allclose([r.w for r in rows], kernel.weights(x), atol=1e-12)
    assert kernel.weights(np.array([kernel.support + 0.01]))[0] == 0
    if kernel.kind != "lanczos":
        for shift in (0.0, 0.25, 0.4):
            assert abs(kernel.weights(np.arange(-5, 6) + shift).sum() - 1) < 1e-12


@pytest.mark.parametrize("blur", [0.75, 1.0, 1.01, 1.25, 2.0])
@pytest.mark.parametrize("kernel", ["bilinear", "bicubic", "lanczos", "spline16", "spline36", "spline64"])
def test_blur_widens_support(kernel, blur):
    r = axis(97, 67, Kernel(kernel, blur=blur), 66.75, 0.125)
    assert r.kernel.support == int(np.ceil(r.kernel.base_support * blur))
    assert planner.build([r])[0].half_bandwidth == min(2 * r.kernel.support - 1, 66)


def test_kernels_reject():
    for bad in ({"kind": "cubic"}, {"kind": "lanczos", "taps": 0}, {"kind": "bicubic", "blur": 0.0}, {"kind": "bicubic", "blur": float("inf")}, {"kind": "custom"}):
        with pytest.raises(ValueError):
            Kernel(**bad)
    assert Kernel("BiCubic").kind == "bicubic" and len(KINDS) == 7
    assert Kernel("spline36", b=0.3).key == Kernel("spline36", c=0.9, taps=8).key


@pytest.mark.parametrize("bad", [{"source_size": 0}, {"active_length": 0.0}, {"shift": float("nan")}, {"border": "wrap"}, {"mode": "f16"}])
def test_requests_reject(bad):
    good = {"source_size": 10, "destination_size": 8, "active_length": 8.0, "shift": 0.0, "kernel": Kernel("bilinear")}
    with pytest.raises(ValueError):
        Request(**good | bad)


@pytest.mark.parametrize(("r", "hb"), FIXTURES)
def test_solutions_are_least_squares(r, hb):
    plan = planner.build([r])[0]
    assert plan.half_bandwidth == hb
    y = np.random.default_rng(3).random((r.source_size, 4))
    want = np.linalg.lstsq(dense(r), y, rcond=None)[0]
    np.testing.assert_allclose(solve.inverse(plan, y), want, atol=1e-9 if plan.double else 2e-5)
    np.testing.assert_allclose(solve.forward(plan, want), dense(r) @ want, atol=1e-12)


def test_bands_are_the_normal_matrix():
    for r, hb in FIXTURES:
        g = dense(r).T @ dense(r)
        bands = planner.build([r])[0].bands
        for d in range(hb + 1):
            np.testing.assert_allclose(bands[d, : len(g) - d], np.diagonal(g, d), atol=1e-14)
        assert np.abs(np.triu(g, hb + 1)).max(initial=0) < 1e-14


def test_plans_built_together_equal_plans_built_alone():
    requests = [r for r, _ in FIXTURES]
    for alone, together in zip((planner.build([r])[0] for r in requests), planner.build(requests), strict=True):
        np.testing.assert_array_equal(alone.factors, together.factors)
        assert (alone.rcond, alone.double) == (together.rcond, together.double)
    a, b = planner.build([requests[0], requests[0]])
    assert a is b


def test_published_anchors():
    """Endpoints by an independent QR solution, and the reciprocal condition, of an ill-conditioned plan."""
    plan = planner.build([axis(1080, 980, Kernel("lanczos", 2), 978.1, 0.95)])[0]
    assert plan.double and abs(plan.rcond / 3.94802e-6 - 1) < 1e-4
    y = ((digests.xorshift32(1080, 0x9781A5C3) & 0xFFFF) / 65535).astype(np.float32)
    x = solve.inverse(plan, y[:, None])[:, 0]
    bound = 4 * planner.EPS / plan.rcond * np.abs(x).max()
    assert abs(x[0] - 74.22802437585693) < bound and abs(x[-1] + 119.91860242539072) < bound
    assert not planner.build([axis(1080, 980, Kernel("lanczos", 2), 978.1, 0.95, mode="f32")])[0].double


def test_identity():
    plan = planner.build([axis(32, 32, Kernel("bilinear"))])[0]
    ramp = np.arange(32)[:, None] / 31
    assert np.abs(solve.inverse(plan, ramp) - ramp).max() < 1e-5


def test_double_rejects_what_is_not_finite():
    plan = planner.build([axis(12, 9, Kernel("bilinear"), mode="f64")])[0]
    y = np.ones((12, 2))
    y[3, 1] = np.nan
    with pytest.raises(ValueError, match="non-finite"):
        solve.inverse(plan, y)
    with pytest.raises(ValueError, match="expected 12"):
        solve.inverse(plan, np.ones((11, 1)))


def test_custom_kernel_equals_its_named_twin():
    named, custom = planner.build([axis(41, 35, Kernel("bilinear")), axis(41, 35, Kernel("custom", 1, weight=lambda x: max(1 - x, 0)))])
    np.testing.assert_allclose(named.factors, custom.factors)
    with pytest.raises(ValueError, match="non-finite"):
        planner.build([axis(41, 35, Kernel("custom", 1, weight=lambda x: float("nan")))])
    with pytest.raises(ValueError, match="zero"):
        planner.build([axis(41, 35, Kernel("custom", 1, weight=lambda x: 0.0))])


def test_roundings(spark):
    v = [2.5, 0.5, -2.5, 0.49999999999999994, -0.5, 3.0]
    assert round_half_up(np.array(v)).tolist() == [3, 1, -2, 0, 0, 3]
    rows = spark.createDataFrame([(x,) for x in v], "v double").select(round_half_up_column(F.col("v")).alias("n")).collect()
    assert [r.n for r in rows] == [3, 1, -2, 0, 0, 3]


@pytest.mark.parametrize(("bits", "full", "chroma", "want"), [(8, False, False, (16, 219, 255)), (10, False, True, (512, 896, 1023)), (8, True, True, (128, 255, 255)), (16, True, False, (0, 65535, 65535))])
def test_ranges(spark, bits, full, chroma, want):
    r = sample_range(bits, full, chroma)
    assert (r.offset, r.scale, r.maximum) == want
    codes = np.arange(0, r.maximum + 1, 7)
    assert r.encode(r.decode(codes, np.float64)).astype(int).tolist() == codes.tolist()
    rows = spark.createDataFrame([(c,) for c in codes[:200].tolist()], "c int").select("c", r.encode_column(r.decode_column(F.col("c"))).alias("d")).collect()
    assert all(x.c == x.d for x in rows)
    assert r.encode(np.array([-9.0, 9.0])).tolist() == [0, r.maximum]


def test_frame_range():
    assert is_full_range({"_Range": 1, "_ColorRange": 0}, False) and not is_full_range({"_ColorRange": 0}, True)
    assert is_full_range(None, True) and not is_full_range({}, False)


def test_codes_stay_within_one(spark):
    h = planner.build([axis(96, 80, Kernel("bicubic"))])[0]
    v = planner.build([axis(64, 48, Kernel("bicubic"))])[0]
    y, x = np.mgrid[:64, :96]
    for bits in (8, 10, 16):
        r = sample_range(bits, True)
        codes = (193 * x + 389 * y + 17 * x * y) % (r.maximum + 1)
        single = solve.inverse_codes(h, v, codes, r)
        plane = r.encode(solve.inverse_double(v, solve.inverse_double(h, r.decode(codes, np.float64).T).T))
        assert np.abs(single - plane).max() <= 1


def test_relational_planner_equals_numpy(spark):
    for r, hb in FIXTURES[:4]:
        taps = relational.taps(spark, r, "r")
        place, distance, w = planner.taps(r)
        rows = sorted(taps.collect(), key=lambda t: (t.src, t.tap))
        np.testing.assert_array_equal([t.dst for t in rows], place.ravel())
        np.testing.assert_allclose([t.w for t in rows], w.ravel(), atol=1e-12)
        bands = np.zeros((hb + 1, r.destination_size))
        for b in relational.normal_bands(relational.coo(taps), hb).collect():
            bands[b.d, b.i] = b.g
        np.testing.assert_allclose(bands, planner.build([r])[0].bands, atol=1e-12)


def test_digests():
    assert digests.stable_hash(b"") == digests.BASIS
    assert digests.ulp_distance(np.float32([1, -0.0, -1e-45]), np.float32([np.nextafter(np.float32(1), np.float32(2)), 0.0, 1e-45])).tolist() == [1, 0, 2]
    assert digests.xorshift32(2, 1).tolist() == [270369, 67634689]


def test_plan_cache():
    from refold.plans import cache

    c = cache.PlanCache(entries=2)
    a, b, d = (axis(40, n, Kernel("bilinear")) for n in (30, 31, 32))
    one = c.get([a, a])
    assert one[0] is one[1] is c.get([a])[0] and c.statistics()["builds"] == 1 and c.statistics()["hits"] == 1
    c.get([b])
    c.get([a])
    c.get([d])  # b was used least recently
    assert set(c.plans) == {a.key, d.key} and c.statistics()["bytes"] == sum(map(cache.size, c.plans.values()))
    custom = axis(40, 30, Kernel("custom", 1, weight=lambda x: max(1 - x, 0)))
    c.get([custom])
    assert custom.key not in c.plans and cache.capabilities()["cpu"]["available"]
    cache.check(one[0])
    one[0].factors[0, 0] = np.nan
    with pytest.raises(ValueError, match="failed"):
        cache.check(one[0])


@pytest.mark.parametrize("chunks", [2, 5, 32])
def test_partitioned_solution_is_the_whole_one(chunks):
    for r in (axis(1080, 980, Kernel("lanczos", 2), 978.1, 0.95), axis(300, 211, Kernel("spline64"), 211, 0.3, "repeat", "f64"), axis(41, 35, Kernel("bilinear"), mode="f64")):
        plan = planner.build([r])[0]
        y = np.random.default_rng(5).random((r.source_size, 3))
        want = solve.inverse_double(plan, y)
        np.testing.assert_allclose(solve.inverse_partitioned(plan, y, chunks), want, atol=1e-9 * max(1, np.abs(want).max()) / max(plan.rcond, 1e-3))
