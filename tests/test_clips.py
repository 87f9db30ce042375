"""The public API over clips: geometry, families, formats, errors, streams."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from refold.functions.kernels import Kernel
from refold.operators import clips, resample, search, solve
from refold.plans import planner
from refold.plans.requests import axis
from refold.streaming import batcher, frames


def formula(frame, plane, y, x):
    return ((193 * x + 389 * y + 521 * plane + 17 * x * y + 31 * frame).bitwiseAND(F.lit(4095))) / 4095


def planes(clip):
    return {(r.frame_no, r.plane): np.array(r.samples).reshape(r.height, r.width) for r in clip.rows.collect()}


@pytest.fixture(scope="module")
def gray(spark):
    return clips.pattern(spark, 96, 64, 3, formula)


@pytest.mark.parametrize("name", ["debilinear", "debicubic", "delanczos", "despline16", "despline36", "despline64"])
def test_functions_undo_both_axes(gray, name):
    out = getattr(resample, name)(gray, 80, 48)
    kind = name.removeprefix("de")
    h, v = planner.build([axis(96, 80, Kernel(kind), border="mirror"), axis(64, 48, Kernel(kind), border="mirror")])
    want = {k: solve.inverse_2d(h, v, p) for k, p in planes(gray).items()}
    got = planes(out)
    assert (out.width, out.height) == (80, 48) and got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], atol=2e-5)


def test_undoing_an_enlargement(spark):
    small = clips.pattern(spark, 48, 40, 2, formula)
    kernel = Kernel("bicubic", b=0.0, c=0.5)
    large = resample.forward_resample(small, 96, 64, kernel)
    back = resample.debicubic(large, 48, 40, padding=3, f64mode=2)
    for k, p in planes(small).items():
        np.testing.assert_allclose(planes(back)[k], p, atol=1e-3)


def test_no_shuffle(gray, capsys):
    resample.debicubic(gray, 80, 48).rows.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_identity_is_the_clip_itself(gray):
    assert resample.debicubic(gray, 96, 64) is gray
    assert resample.debicubic(gray, 96, 64, force=True) is not gray
    np.testing.assert_allclose(planes(resample.debilinear(gray, 96, 64, force_h=True))[0, 0], planes(gray)[0, 0], atol=1e-5)


def test_borders_and_windows(spark):
    clip = clips.blank(spark, 96, 64, 1, 0.35)
    for args in ({"padding": 1}, {"padding": 2}, {"padding": 3}, {"border_handling": 0}, {"border_handling": 2}):
        out = planes(resample.debicubic(clip, 80, 48, src_left=0.25, src_top=0.125, src_width=79.5, src_height=47.75, **args))[0, 0]
        np.testing.assert_allclose(out[4:-4, 4:-4], 0.35, atol=1e-4)


@pytest.mark.parametrize(
    ("args", "message"),
    [
        ({"kernel": "cubic"}, "unknown kernel"), ({"blur": 0.0}, "blur"), ({"blur": 64.0}, "blur"), ({"kernel": "lanczos", "taps": 0}, "taps"), ({"padding": 4}, "padding"), ({"border_handling": 3}, "border_handling"),
        ({"padding": 0, "border_handling": 0}, "both"), ({"f64mode": 3}, "f64mode"), ({"custom": abs}, "taps or support"), ({"kernel": "bilinear", "custom": abs, "taps": 2}, "both"), ({"width": 97}, "exceed"), ({"height": 4}, "small"),
        ({"backend": "vulkan"}, "backend"), ({"src_width": -1.0}, "active length"),
    ],
)
def test_errors_are_eager(gray, args, message):
    with pytest.raises(ValueError, match=message):
        resample.inverse_resample(gray, **{"width": 80, "height": 48} | args)


def test_precedence_of_custom_and_taps(gray):
    one = planes(resample.inverse_resample(gray, 80, 48, custom=lambda x: max(1 - x, 0), custom_kernel=lambda x: 1 / 0, taps=1, support=9))
    np.testing.assert_allclose(one[0, 0], planes(resample.debilinear(gray, 80, 48))[0, 0], atol=1e-5)


def test_codes_and_ranges(spark):
    clip = clips.pattern(spark, 96, 64, 2, lambda f, p, y, x: (193 * x + 389 * y + 17 * x * y) % 256)
    clip = clip.of(clip.rows.withColumn("props", F.when(F.col("frame_no") == 0, F.create_map(F.lit("_Range"), F.lit(1).cast("bigint"))).otherwise(F.col("props"))), bits=8)
    got = planes(resample.debicubic(clip, 80, 48))
    through = planes(resample.convert(resample.debicubic(resample.convert(clip, 32), 80, 48), 8))
    for k, p in got.items():
        assert np.abs(p - through[k]).max() <= 1 and p.min() >= 0 and p.max() <= 255 and (p == np.rint(p)).all()


def test_yuv_420(spark):
    luma, chroma = clips.pattern(spark, 96, 64, 1, formula), clips.pattern(spark, 48, 32, 1, formula, planes=3)
    yuv = clips.join_planes(luma, chroma).of(clips.join_planes(luma, chroma).rows, sub_w=1, sub_h=1)
    out = planes(resample.debicubic(yuv, 80, 48, padding=3))
    assert {k: p.shape for k, p in out.items()} == {(0, 0): (48, 80), (0, 1): (24, 40), (0, 2): (24, 40)}
    h, v = planner.build([axis(48, 40, Kernel("bicubic"), shift=0.25 - 0.25 * 80 / 96), axis(32, 24, Kernel("bicubic"))])
    np.testing.assert_allclose(out[0, 1], solve.inverse_2d(h, v, planes(chroma)[0, 1]), atol=2e-5)
    wrapped = planes(resample.inverse_by_family(yuv, 80, 48, "bicubic"))
    assert wrapped[0, 1].shape == (24, 40) and resample.inverse_by_family(yuv, 80, 48, "bicubic", gray=True).planes == 1
    with pytest.raises(ValueError, match="divisible"):
        resample.debicubic(yuv, 81, 48)


def test_search_finds_the_kernel(spark):
    kernel = Kernel("bicubic", b=0.0, c=0.5)
    small = clips.pattern(spark, 48, 48, 1, formula)
    clip = resample.forward_resample(small, 64, 64, kernel)
    rows = search.plane_search(spark, clip, search.GETNATIVE, [40.0, 48.0, 56.0], 3).collect()
    best = min(rows, key=lambda r: r.mae)
    assert len(rows) == 33 and (best.scaler, best.size) == ("bicubic_b0.0_c0.5", 48.0)


def test_measures_are_null_for_no_error():
    m = search.measures(np.ones((4, 2), np.float32), np.ones((4, 2), np.float32), 0.015, "keep_under")
    assert np.isnan(m[4]).all() and (m[0] == 0).all()


def test_streams(spark, gray, tmp_path):
    gray.rows.write.parquet(f"{tmp_path}/in")
    live = frames.frames(spark, f"{tmp_path}/in", 96, 64)
    frames.inverse_stream(live, 80, 48, kernel="bicubic").writeStream.format("memory").queryName("inverse").trigger(availableNow=True).start().awaitTermination()
    got = {r.frame_no: np.array(r.samples) for r in spark.table("inverse").collect()}
    want = {k[0]: p.ravel() for k, p in planes(resample.debicubic(gray, 80, 48)).items()}
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], atol=1e-6)


def test_batcher(spark, tmp_path):
    spark.range(40).selectExpr("cast(id % 2 as string) as k", "id").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, id long").parquet(f"{tmp_path}/in")
    q = batcher.batches(stream, "k", 8, 60_000).writeStream.format("memory").queryName("batches").outputMode("append").trigger(processingTime="1 second").start()
    for _ in range(40):  # a query with timeouts never runs out of batches by itself
        time.sleep(0.5)
        if spark.table("batches").count() == 4:
            break
    q.stop()
    assert sorted((r.key, r.batch, r.n, r.full) for r in spark.table("batches").collect()) == [(k, b, 8, True) for k in "01" for b in (0, 1)]


def test_packed_planes_give_the_same(gray):
    plain, packed = resample.debicubic(gray, 80, 48), resample.debicubic(resample.packed(gray), 80, 48)
    assert packed.rows.schema["samples"].dataType.simpleString() == "binary"
    got = planes(resample.unpacked(packed))
    for k, p in planes(plain).items():
        np.testing.assert_array_equal(got[k], p)
    forward = planes(resample.unpacked(resample.forward_resample(resample.packed(gray), 100, 70, Kernel("spline36"))))
    np.testing.assert_array_equal(forward[0, 0], planes(resample.forward_resample(gray, 100, 70, Kernel("spline36")))[0, 0])
