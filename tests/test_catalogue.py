"""Every registered query runs, and equals its SQL where there is some."""

import hashlib
import json
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from refold import catalogue
from refold.operators import intervals, stats
from refold.sources import traces

SF = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, float) and math.isfinite(v):
        return f"{v:.9g}"
    return str(v)


def plain(rows):
    return sorted(tuple(value(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = got.select(*sorted(got.columns)).collect()
    if name in catalogue.ORACLES:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        want = con.sql(catalogue.ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(rows) == plain(want.select(", ".join(f'"{c}"' for c in sorted(want.columns))).fetchall())
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_incomplete_pairs_fail(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "k int, v string, x double")
    assert stats.pairs(df.where("k = 1"), "v", "a", "b", "x", "k").first().ratio == 2.0
    with pytest.raises(Exception, match="incomplete pair"):
        stats.pairs(df, "v", "a", "b", "x", "k").collect()


def test_phases_map_one_to_one(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "x")], "id int, name string")
    batches = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    assert stats.phases_of(rows, batches(1, 2), "id", "name", ("x", "y")).count() == 4
    for ids in ((1, 3), (1, 1)):
        with pytest.raises(Exception, match="one to one"):
            stats.phases_of(rows, batches(*ids), "id", "name", ("x", "y")).collect()


def test_errors_of_nothing_and_of_what_is_not_finite(spark):
    rows = spark.createDataFrame([(1.0, 3.0), (1.0, float("inf")), (2.0, float("nan")), (4.0, 4.0)], "a double, b double")
    assert tuple(stats.error_stats(rows, "a", "b").first()) == (2.0, 0.5, 2)
    assert tuple(stats.error_stats(rows.where("a > 9"), "a", "b").first()) == (0.0, 0.0, 0)
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a"), (3, "a"), (3, "b"), (3, None)], "k int, v string")
    assert {r.k: r.same for r in stats.same_members(members, "v", ("a", "b"), "k").collect()} == {1: True, 2: False, 3: False}


def test_touching_intervals_are_one(spark):
    df = spark.createDataFrame([(0, 4), (4, 6), (8, 9), (8, 12), (20, 20)], "s long, e long")
    r = intervals.union_length(df, "s", "e").first()
    assert (r.covered, r.n_islands) == (10, 2)
    assert intervals.peak_concurrency(df.where("s < e"), "s", "e").first().peak == 2


def test_bootstrap_repeats(spark):
    df = spark.createDataFrame([("a", 1 + k / 10) for k in range(9)], "k string, ratio double")
    one, two = (stats.bootstrap_median_ratio(df, 200, 5, "k").first() for _ in range(2))
    assert one == two and one.lower <= one.median <= one.upper


def test_bootstrap_takes_all_pairs(spark):
    got = {r.c_mktsegment: r.n for r in catalogue.QUERIES["bootstrap_ci"](spark, SF).collect()}
    assert got == {r.c_mktsegment: r.n for r in catalogue.QUERIES["regression_gate"](spark, SF).collect()}


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_middle_ranks_are_those_of_resamples(n):
    rng, draws = random.Random(4), 20_000
    plain_ = [sorted(rng.choices(range(1, n + 1), k=n)) for _ in range(draws)]
    for got, want in zip(zip(*stats.middle_ranks(rng, n, draws)), zip(*((s[(n - 1) // 2], s[n // 2]) for s in plain_))):
        a, b = sorted(got), sorted(want)
        assert abs(sum(a) - sum(b)) / draws < 0.02 * n and all(abs(a[int(p * draws)] - b[int(p * draws)]) <= 1 for p in (0.025, 0.5, 0.975))


def test_evidence_and_gates(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema": "v1", "n": 3}))
    assert traces.evidence(spark, f"{tmp_path}/a.json", "schema string, n int", "v1").first().n == 3
    with pytest.raises(Exception, match="unexpected evidence"):
        traces.evidence(spark, f"{tmp_path}/a.json", "schema string, n int", "v2").collect()


def test_xml_trace(spark, tmp_path):
    doc = '<trace><node><schema name="s"><col><mnemonic>start</mnemonic></col><col><mnemonic>name</mnemonic></col></schema><row><t id="1" fmt="a">10</t><n id="2">x</n></row><row><t ref="1"/><n ref="2"/></row></node></trace>'
    (tmp_path / "t.xml").write_text(doc)
    rows = [(r.row, r.column, r.raw) for r in traces.xml_trace(spark, f"{tmp_path}/t.xml").collect()]
    assert rows == [(0, "start", "10"), (0, "name", "x"), (1, "start", "10"), (1, "name", "x")]
    (tmp_path / "u.xml").write_text(doc.replace('ref="1"', 'ref="9"'))
    with pytest.raises(Exception, match="unknown reference"):
        traces.xml_trace(spark, f"{tmp_path}/u.xml").collect()
    (tmp_path / "c.xml").write_text(doc.replace('id="1" fmt="a"', 'id="1" ref="1"'))
    with pytest.raises(Exception, match="cycle"):
        traces.xml_trace(spark, f"{tmp_path}/c.xml").collect()


def test_references_as_a_join(spark):
    df = spark.createDataFrame([("f", 1, None, "x"), ("f", None, 1, None)], "f string, id int, ref int, v string")
    assert sorted(r.v for r in traces.resolve(df, "f", "id", "ref", "v").collect()) == ["x", "x"]
    with pytest.raises(Exception, match="unknown reference"):
        traces.resolve(df.where("id is null"), "f", "id", "ref", "v").collect()


def test_text_reports(spark):
    lines = spark.createDataFrame([("Output 120 frames in 4.00 seconds (30.00 fps)",), ("noise",), ("My Filter  parallel  12.50  3.25",)], "l string")
    assert tuple(traces.runner_timing(lines, "l").first()) == (120, 4.0, 30.0)
    assert tuple(traces.filter_times(lines, "l").first()) == ("My Filter", "parallel", 12.5, 3.25)


def test_flat_csv_and_tree_digest(spark, tmp_path):
    df = spark.createDataFrame([(1, (2.0, "x"))], "a int, b struct<c: double, d: string>")
    traces.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == ["a", "b_c", "b_d"]
    files = spark.createDataFrame([("a-b", bytearray(b"3")), ("a/b", bytearray(b"2"))], "path string, content binary")
    parts = b"".join(len(p).to_bytes(8, "little") + p + hashlib.sha256(c).digest() for p, c in ((b"a/b", b"2"), (b"a-b", b"3")))
    assert traces.tree_digest(files).first().digest == hashlib.sha256(parts).hexdigest()
    files = spark.createDataFrame([("b", bytearray(b"2")), ("a", bytearray(b"1"))], "path string, content binary")
    assert traces.tree_digest(files).first().digest == traces.tree_digest(files.orderBy("path")).first().digest != traces.tree_digest(files.where("path = 'a'")).first().digest


def test_segments_and_eval(spark):
    from refold.operators import clips

    df = spark.createDataFrame([(k, v) for k, v in enumerate("aabba")], "n int, v string").withColumn("p", F.lit(1))
    assert [r.segment for r in clips.segments(df, "n", "v", "p").orderBy("n").collect()] == [1, 1, 2, 2, 3]
