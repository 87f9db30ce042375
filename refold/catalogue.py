"""Registered queries of the resampling engine, over the whole tables, and the SQL that checks them.

The SQL is written from the definitions, not generated from the Spark code: kernels in their textbook
form, solutions by conjugate gradients instead of factors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refold.functions import borders, digests
from refold.functions.kernels import Kernel
from refold.functions.numbers import round_half_up_column, sample_range
from refold.operators import clips, intervals, resample, search, stats
from refold.plans import relational
from refold.plans.requests import axis
from refold.streaming import batcher, frames

FLAGSHIP = "candidate_search"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers f(spark, read) under its name; read(table) gives a DataFrame."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        key = name or f.__name__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _r(column, digits: int = 6):
    return F.round(column, digits) + F.lit(0.0)


# ---------------------------------------------------------------- scalar functions

KERNELS = {
    "bilinear": (Kernel("bilinear"), "greatest(1 - x, 0)"),
    "bicubic": (Kernel("bicubic"), "CASE WHEN x < 1 THEN 1.5*x**3 - 2.5*x**2 + 1 WHEN x < 2 THEN -0.5*x**3 + 2.5*x**2 - 4*x + 2 ELSE 0 END"),
    "mitchell": (Kernel("bicubic", b=1 / 3, c=1 / 3), "CASE WHEN x < 1 THEN (7*x**3 - 12*x**2 + 16/3.0)/6 WHEN x < 2 THEN (-7/3.0*x**3 + 12*x**2 - 20*x + 32/3.0)/6 ELSE 0 END"),
    "lanczos": (Kernel("lanczos", 3), "CASE WHEN x = 0 THEN 1 WHEN x < 3 THEN 3*sin(pi()*x)*sin(pi()*x/3)/(pi()*x)**2 ELSE 0 END"),
    "spline16": (Kernel("spline16"), "CASE WHEN x < 1 THEN ((x - 9/5.0)*x - 1/5.0)*x + 1 WHEN x < 2 THEN ((-1/3.0*(x-1) + 4/5.0)*(x-1) - 7/15.0)*(x-1) ELSE 0 END"),
    "spline36": (Kernel("spline36"), "CASE WHEN x < 1 THEN ((13/11.0*x - 453/209.0)*x - 3/209.0)*x + 1 WHEN x < 2 THEN ((-6/11.0*(x-1) + 270/209.0)*(x-1) - 156/209.0)*(x-1) WHEN x < 3 THEN ((1/11.0*(x-2) - 45/209.0)*(x-2) + 26/209.0)*(x-2) ELSE 0 END"),
    "spline64": (Kernel("spline64"), "CASE WHEN x < 1 THEN ((49/41.0*x - 6387/2911.0)*x - 3/2911.0)*x + 1 WHEN x < 2 THEN ((-24/41.0*(x-1) + 4032/2911.0)*(x-1) - 2328/2911.0)*(x-1) WHEN x < 3 THEN ((6/41.0*(x-2) - 1008/2911.0)*(x-2) + 582/2911.0)*(x-2) WHEN x < 4 THEN ((-1/41.0*(x-3) + 168/2911.0)*(x-3) - 97/2911.0)*(x-3) ELSE 0 END"),
}


def _kernel_query(name: str):
    kernel, formula = KERNELS[name]

    @query(f"SELECT l_orderkey, l_linenumber, round({formula}, 6) + 0.0 AS w FROM (SELECT l_orderkey, l_linenumber, (l_discount * 40)::DOUBLE AS x FROM lineitem)", f"kernel_weights_{name}")
    def weights(spark, read):
        return read("lineitem").select("l_orderkey", "l_linenumber", _r(kernel.column(F.col("l_discount") * 40)).alias("w"))


for _name in KERNELS:
    _kernel_query(_name)

_BORDER_SQL = {
    "zero": "CASE WHEN i BETWEEN 0 AND 36 THEN i ELSE -1 END",
    "repeat": "least(greatest(i, 0), 36)",
    "reflect101": "CASE WHEN ((i % 72) + 72) % 72 < 37 THEN ((i % 72) + 72) % 72 ELSE 72 - ((i % 72) + 72) % 72 END",
    "symmetric": "CASE WHEN ((i % 74) + 74) % 74 < 37 THEN ((i % 74) + 74) % 74 ELSE 73 - ((i % 74) + 74) % 74 END",
    "mirror": "CASE WHEN i BETWEEN 0 AND 36 THEN i WHEN i BETWEEN -37 AND -1 THEN -1 - i WHEN i BETWEEN 37 AND 73 THEN 73 - i ELSE -1 END",
}


def _border_query(border: str):
    @query(f"SELECT event_id, ({_BORDER_SQL[border]})::BIGINT AS place FROM (SELECT event_id, event_id % 300 - 130 AS i FROM events)", f"padding_{border}")
    def place(spark, read):
        return read("events").select("event_id", borders.column(F.col("event_id") % 300 - 130, 37, border).cast("long").alias("place"))


for _border in borders.BORDERS:
    _border_query(_border)


@query("SELECT event_id, (CASE WHEN v < 0 THEN floor(v + 0.5) ELSE floor(v + 0.49999999999999994) END)::BIGINT AS n FROM (SELECT event_id, floor(value) / 2 - 20 AS v FROM events)")
def round_half_up(spark, read):
    return read("events").select("event_id", round_half_up_column(F.floor("value") / 2 - 20).alias("n"))


def _convert_query(name: str, bits: int, full: bool, chroma: bool, offset: int, scale: int):
    @query(f"SELECT event_id, round_even(least(greatest(value / 100 * {scale} + {offset}, 0), {(1 << bits) - 1}), 0)::INTEGER AS code FROM events", f"int_convert_{name}")
    def code(spark, read):
        return read("events").select("event_id", sample_range(bits, full, chroma).encode_column(F.col("value") / 100).alias("code"))


_convert_query("limited", 8, False, False, 16, 219)
_convert_query("full", 10, True, False, 0, 1023)
_convert_query("chroma", 8, False, True, 128, 224)


@query("SELECT p_partkey, lower(p_brand) AS brand, regexp_extract(p_name, '([0-9]+)', 1) AS number, split_part(p_type, ' ', 1) AS head, printf('%s@%.1f', p_brand, p_size / 10.0) AS label FROM part")
def text_functions(spark, read):
    return read("part").select("p_partkey", F.lower("p_brand").alias("brand"), F.regexp_extract("p_name", "([0-9]+)", 1).alias("number"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("head"), F.format_string("%s@%.1f", "p_brand", F.col("p_size") / 10.0).alias("label"))


# ---------------------------------------------------------------- the planner as relations

#: Requests that the embeddings (64 samples) are taken to be made by.
REQUESTS = {
    "hb1": (axis(64, 48, Kernel("bilinear"), 48, 0.0, "symmetric", "f64"), KERNELS["bilinear"][1]),
    "hb3": (axis(64, 44, Kernel("bicubic"), 43.5, 0.25, "reflect101", "f64"), KERNELS["bicubic"][1]),
    "hb5": (axis(64, 40, Kernel("spline36"), 40, 0.125, "repeat", "f64"), KERNELS["spline36"][1]),
}


def _taps_sql(name: str) -> str:
    r, formula = REQUESTS[name]
    n, s = r.destination_size, r.kernel.support
    place = {
        "symmetric": f"CASE WHEN (j % {2 * n} + {2 * n}) % {2 * n} < {n} THEN (j % {2 * n} + {2 * n}) % {2 * n} ELSE {2 * n - 1} - (j % {2 * n} + {2 * n}) % {2 * n} END",
        "reflect101": f"CASE WHEN (j % {2 * n - 2} + {2 * n - 2}) % {2 * n - 2} < {n} THEN (j % {2 * n - 2} + {2 * n - 2}) % {2 * n - 2} ELSE {2 * n - 2} - (j % {2 * n - 2} + {2 * n - 2}) % {2 * n - 2} END",
        "repeat": f"least(greatest(j, 0), {n - 1})",
    }[r.border]
    return f"""
pos_{name} AS (SELECT a.range AS src, t.range AS tap, (a.range + 0.5::DOUBLE) / (64 / {r.active_length}::DOUBLE) + {r.shift}::DOUBLE AS p FROM range(64) a, range({2 * s}) t),
dist_{name} AS (SELECT src, tap, floor(p - {s} + 0.5)::BIGINT + tap AS j, floor(p - {s} + 0.5) + 0.5 + tap - p AS distance FROM pos_{name}),
raw_{name} AS (SELECT *, ({formula})::DOUBLE AS k FROM (SELECT *, abs(distance) AS x FROM dist_{name})),
taps_{name} AS (SELECT '{name}' AS req_id, src, tap, ({place}) AS dst, distance, k / sum(k) OVER (PARTITION BY src) AS w FROM raw_{name}),
coo_{name} AS (SELECT req_id, src, dst, sum(w) AS w FROM taps_{name} WHERE w <> 0 GROUP BY ALL),
bands_{name} AS (SELECT a.req_id, a.dst AS i, b.dst - a.dst AS d, sum(a.w * b.w) AS g FROM coo_{name} a JOIN coo_{name} b ON a.src = b.src WHERE b.dst - a.dst BETWEEN 0 AND {r.half_bandwidth} GROUP BY ALL),
y_{name} AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS src, unnest(embedding)::DOUBLE AS y FROM embeddings),
rhs_{name} AS (SELECT req_id, vec_id, dst AS i, sum(w * y) AS v FROM y_{name} JOIN coo_{name} USING (src) GROUP BY ALL)"""


_ALL = "WITH " + ",".join(_taps_sql(n) for n in REQUESTS)


def _union(select: str) -> str:
    return _ALL + " " + " UNION ALL ".join(select.format(n) for n in REQUESTS)


def _taps(spark, name: str) -> DataFrame:
    return relational.taps(spark, REQUESTS[name][0], name)


def _each(f) -> DataFrame:
    out = None
    for name in REQUESTS:
        out = f(name) if out is None else out.unionByName(f(name))
    return out


@query(_union("SELECT req_id, src::INTEGER AS src, tap::INTEGER AS tap, dst::INTEGER AS dst, round(distance, 9) + 0.0 AS distance, round(w, 9) + 0.0 AS w FROM taps_{}"))
def taps(spark, read):
    return _each(lambda n: _taps(spark, n)).withColumns({"distance": _r("distance", 9), "w": _r("w", 9)})


@query(_union("SELECT req_id, src::INTEGER AS src, dst::INTEGER AS dst, round(w, 9) + 0.0 AS w FROM coo_{}"))
def coo(spark, read):
    return _each(lambda n: relational.coo(_taps(spark, n))).withColumn("w", _r("w", 9))


@query(_union("SELECT req_id, i::INTEGER AS i, d::INTEGER AS d, round(g, 9) + 0.0 AS g FROM bands_{}"))
def normal_bands(spark, read):
    return _each(lambda n: relational.normal_bands(relational.coo(_taps(spark, n)), REQUESTS[n][0].half_bandwidth)).withColumn("g", _r("g", 9))


@query(_union("SELECT req_id, vec_id, i::INTEGER AS i, round(v, 6) + 0.0 AS v FROM rhs_{}"))
def rhs(spark, read):
    return _each(lambda n: relational.right_sides(relational.coo(_taps(spark, n)), read("embeddings"), "vec_id", "embedding")).withColumn("v", _r("v"))


@query(_union("SELECT req_id, round(max(s), 8) + 0.0 AS one_norm, round(min(2 * diagonal - s), 8) + 0.0 AS margin FROM (SELECT req_id, k, sum(abs(g)) AS s, sum(CASE WHEN d = 0 THEN abs(g) ELSE 0 END) AS diagonal FROM (SELECT req_id, i AS k, d, g FROM bands_{0} UNION ALL SELECT req_id, i + d, d, g FROM bands_{0} WHERE d > 0) GROUP BY ALL) GROUP BY ALL"))
def band_norm(spark, read):
    bands = _each(lambda n: relational.normal_bands(relational.coo(_taps(spark, n)), REQUESTS[n][0].half_bandwidth))
    return relational.band_norm(bands).withColumns({"one_norm": _r("one_norm", 8), "margin": _r("margin", 8)})


# ---------------------------------------------------------------- the solver


def _solution_sql(name: str, steps: int = 150) -> str:
    n = REQUESTS[name][0].destination_size
    at = f"range(1, {n + 1})"
    return f"""
WITH RECURSIVE {_taps_sql(name)},
full_ AS (SELECT i, i + d AS j, g FROM bands_{name} UNION ALL SELECT i + d, i, g FROM bands_{name} WHERE d > 0),
dense AS (SELECT a.range AS i, list(coalesce(g, 0.0) ORDER BY b.range) AS row FROM range({n}) a CROSS JOIN range({n}) b LEFT JOIN full_ ON full_.i = a.range AND full_.j = b.range GROUP BY a.range),
m AS (SELECT list(row ORDER BY i) AS g FROM dense),
b AS (SELECT vec_id, list(v ORDER BY i) AS b FROM rhs_{name} GROUP BY vec_id),
cg AS (
  SELECT 0 AS k, vec_id, list_transform(b, lambda v: 0.0::DOUBLE) AS x, b AS r, b AS p, list_dot_product(b, b) AS rs FROM b
  UNION ALL
  SELECT k + 1, vec_id, x2, r2, list_transform({at}, lambda i: r2[i] + rs2 / rs * p[i]), rs2
  FROM (SELECT *, list_dot_product(r2, r2) AS rs2
    FROM (SELECT *, list_transform({at}, lambda i: x[i] + step * p[i]) AS x2, list_transform({at}, lambda i: r[i] - step * q[i]) AS r2
      FROM (SELECT *, rs / list_dot_product(p, q) AS step FROM (SELECT cg.*, list_transform(g, lambda row: list_dot_product(row, p)) AS q FROM cg, m WHERE rs > 1e-26 AND k < {steps}))))),
done AS (SELECT vec_id, arg_max(x, k) AS x FROM cg GROUP BY vec_id)
SELECT vec_id, (generate_subscripts(x, 1) - 1)::INTEGER AS i, round(unnest(x), 5) + 0.0 AS v FROM done
"""


def _solution_query(name: str):
    @query(_solution_sql(name), f"inverse_axis_1d_{name}")
    def inverse_axis(spark, read):
        solved = resample.inverse_rows(read("embeddings"), "embedding", REQUESTS[name][0], ("vec_id",))
        return solved.select("vec_id", F.posexplode("samples").alias("i", "v")).withColumn("v", _r("v", 5))


for _name in REQUESTS:
    _solution_query(_name)


def _planes(read, scale: float = 1.0, offset: float = 0.0) -> clips.Clip:
    """Each embedding as an 8 x 8 frame."""
    rows = read("embeddings").select(
        F.lit("embeddings").alias("clip_id"), F.col("vec_id").cast("int").alias("frame_no"), F.lit(0).alias("plane"), F.lit(8).alias("width"), F.lit(8).alias("height"),
        F.transform("embedding", lambda x: (x * F.lit(scale) + F.lit(offset)).cast("float")).alias("samples"), F.create_map().cast("map<string,bigint>").alias("props"),
    )
    return clips.Clip(rows, 8, 8)


def _shown(clip: clips.Clip) -> DataFrame:
    """Frames as sums: plain, and weighted by place (so the order counts)."""
    s = F.col("samples")
    plain = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    placed = F.aggregate(F.transform(s, lambda x, k: x.cast("double") * (k + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return clip.rows.select("frame_no", "plane", "width", "height", F.size(s).alias("n"), _r(plain, 4).alias("total"), _r(placed, 3).alias("placed"))


def _frames_sql(cells: str) -> str:
    """cells: SELECT frame_no, plane, width, height, k (place from 1), v."""
    return f"""
WITH px AS (SELECT vec_id::INTEGER AS f, ((s - 1) // 8)::INTEGER AS y, ((s - 1) % 8)::INTEGER AS x, e::FLOAT AS v FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS s, unnest(embedding) AS e FROM embeddings)),
cells AS ({cells})
SELECT frame_no::INTEGER AS frame_no, plane::INTEGER AS plane, width::INTEGER AS width, height::INTEGER AS height, count(*)::INTEGER AS n, round(sum(v::DOUBLE), 4) + 0.0 AS total, round(sum(v::DOUBLE * k), 3) + 0.0 AS placed
FROM cells GROUP BY ALL
"""


@query()
def inverse_2d(spark, read):
    """Frames of 8 x 8 to 8 x 6 (height stays, as outputs have 8 rows at least)."""
    return _shown(resample.debicubic(_planes(read), 6, 8, src_left=0.25, padding=3, f64mode=2))


@query()
def inverse_u8(spark, read):
    clip = clips.Clip(resample.convert(_planes(read, 0.1, 0.5), 8).rows, 8, 8, "GRAY", 8)
    return _shown(resample.debilinear(clip, 6, 8, padding=1))


@query()
def forward_2d(spark, read):
    return _shown(resample.forward_resample(_planes(read), 12, 12, Kernel("spline36")))


# ---------------------------------------------------------------- frames


@query("SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) + 0.0 AS average, list_min(embedding)::DOUBLE AS minimum, list_max(embedding)::DOUBLE AS maximum FROM embeddings")
def plane_stats(spark, read):
    out = clips.plane_stats(read("embeddings"), "embedding", "vec_id")
    return out.withColumns({"average": _r("average"), "minimum": F.col("minimum").cast("double"), "maximum": F.col("maximum").cast("double")})


def _compare_query(mode: str):
    counted = "d > 0.3::FLOAT" if mode == "keep_over" else "d <= 0.3::FLOAT"

    @query(
        f"""
WITH p AS (SELECT a.vec_id, unnest(a.embedding)::FLOAT AS x, unnest(b.embedding)::FLOAT AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
d AS (SELECT vec_id, abs(x - y)::FLOAT AS d FROM p),
m AS (SELECT vec_id, max(d) AS max_abs, avg(d::DOUBLE) AS mae, avg((d * d)::FLOAT::DOUBLE) AS mse, avg(CASE WHEN {counted} THEN d::DOUBLE ELSE 0 END) AS t, avg(CASE WHEN d > 0.3::FLOAT THEN 1.0 ELSE 0 END) AS o FROM d GROUP BY ALL)
SELECT vec_id, round(max_abs::DOUBLE, 6) + 0.0 AS max_abs, round(mae, 6) + 0.0 AS mae, round(mse, 6) + 0.0 AS mse, round(sqrt(mse), 6) + 0.0 AS rmse, CASE WHEN mse > 0 THEN round(-10 * log10(mse), 5) + 0.0 END AS psnr, round(t, 6) + 0.0 AS thresholded_mae, round(o, 6) + 0.0 AS fraction_over FROM m
""",
        f"compare_metrics_{mode}",
    )
    def compare(spark, read):
        e = read("embeddings")
        both = e.select("vec_id", F.col("embedding").cast("array<float>").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<float>").alias("y")), "vec_id")
        out = clips.compare(both, "x", "y", 0.3, mode, "vec_id")
        return out.withColumns({c: _r(F.col(c).cast("double"), 5 if c == "psnr" else 6) for c in out.columns if c != "vec_id"})


_compare_query("keep_over")
_compare_query("keep_under")


@query(_frames_sql("SELECT f AS frame_no, 0 AS plane, 5 AS width, 5 AS height, (y - 2) * 5 + x - 1 AS k, v FROM px WHERE x BETWEEN 2 AND 6 AND y BETWEEN 2 AND 6"))
def crop(spark, read):
    return _shown(clips.crop(_planes(read), 2, 1, 2, 1))


@query(_frames_sql("SELECT f AS frame_no, 0 AS plane, 11 AS width, 12 AS height, (y + 1) * 11 + x + 2 AS k, v FROM px UNION ALL SELECT DISTINCT f, 0, 11, 12, b.range * 11 + a.range + 1, 0.5::FLOAT FROM px, range(11) a, range(12) b WHERE NOT (a.range BETWEEN 1 AND 8 AND b.range BETWEEN 1 AND 8)"))
def add_borders(spark, read):
    return _shown(clips.add_borders(_planes(read), 1, 2, 1, 3, 0.5))


@query(_frames_sql("SELECT f - 10 AS frame_no, 0 AS plane, 8 AS width, 8 AS height, y * 8 + x + 1 AS k, v FROM px WHERE f BETWEEN 10 AND 59"))
def trim(spark, read):
    return _shown(clips.trim(_planes(read), 10, 59))


@query(_frames_sql("SELECT r.range * (SELECT count(*) FROM embeddings) + f AS frame_no, 0 AS plane, 8 AS width, 8 AS height, y * 8 + x + 1 AS k, v FROM px, range(3) r"))
def loop(spark, read):
    return _shown(clips.loop(_planes(read), 3, read("embeddings").count()))


@query(_frames_sql("SELECT CASE WHEN f >= 40 THEN f - 40 ELSE f + (SELECT count(*) FROM embeddings) - 40 END AS frame_no, 0 AS plane, 8 AS width, 8 AS height, y * 8 + x + 1 AS k, v FROM px"))
def splice(spark, read):
    clip, n = _planes(read), read("embeddings").count()
    return _shown(clips.splice([(clips.trim(clip, 40, n - 1), n - 40), (clips.trim(clip, 0, 39), 40)]))


@query(_frames_sql("SELECT f // 3 AS frame_no, f % 3 AS plane, 8 AS width, 8 AS height, y * 8 + x + 1 AS k, CASE WHEN f % 3 = 0 THEN v * 2 ELSE v END AS v FROM px"))
def shuffle_planes(spark, read):
    clip = _planes(read)
    parts = clip.of(clip.rows.withColumns({"plane": F.col("frame_no") % 3, "frame_no": F.floor(F.col("frame_no") / 3).cast("int")}), family="YUV")
    luma = clips.expr([clips.take_plane(parts, 0)], lambda x: x * F.lit(2.0).cast("float"))
    return _shown(clips.join_planes(luma, parts))


@query(_frames_sql("SELECT a.f AS frame_no, 0 AS plane, 8 AS width, 8 AS height, a.y * 8 + a.x + 1 AS k, CASE WHEN abs(a.v - b.v) > 0.2::FLOAT THEN abs(a.v - b.v) ELSE 0 END AS v FROM px a JOIN px b ON b.f = a.f + 1 AND a.x = b.x AND a.y = b.y"))
def expr_difference(spark, read):
    clip = _planes(read)
    after = clip.of(clip.rows.withColumn("frame_no", F.col("frame_no") - 1))
    return _shown(clips.expr([clip, after], clips.keep_over(0.2)))


@query(_frames_sql("SELECT n.range AS frame_no, 0 AS plane, 4 AS width, 3 AS height, k.range + 1 AS k, 0.25::FLOAT AS v FROM range(5) n, range(12) k"))
def blank_clip(spark, read):
    return _shown(clips.blank(spark, 4, 3, 5, 0.25))


@query("SELECT event_id, event_type, (sum(change) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS segment FROM (SELECT event_id, event_type, user_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS change FROM events)")
def run_segments(spark, read):
    return clips.segments(read("events"), "event_id", "event_type", "user_id").select("event_id", "event_type", "segment")


@query(_frames_sql("SELECT f AS frame_no, 0 AS plane, 8 AS width, 8 AS height, y * 8 + x + 1 AS k, (v * (label + 1))::FLOAT AS v FROM px JOIN embeddings ON f = vec_id"))
def frame_eval(spark, read):
    clip = _planes(read)
    chosen = read("embeddings").select(F.col("vec_id").alias("n"), "label")
    return _shown(clip.of(clips.frame_eval(clip, chosen, "n", lambda s: F.transform(s, lambda x: (x * (F.col("label") + 1)).cast("float")))))


# ---------------------------------------------------------------- candidates


@query("WITH s AS (SELECT unnest(['bilinear','bicubic','lanczos3']) AS scaler, generate_subscripts(['a','b','c'], 1) - 1 AS s_pos), h AS (SELECT range AS pos, (7000 + range) / 10.0::DOUBLE AS height FROM range(2800)) SELECT ((r.range * 3 + s_pos) * 2800 + pos)::BIGINT AS idx, r.range::INTEGER AS rep, scaler, height::DOUBLE AS height, printf('%s@%.1f', scaler, height) AS id FROM range(2) r, s, h")
def candidate_grid(spark, read):
    scalers = spark.createDataFrame(list(enumerate(["bilinear", "bicubic", "lanczos3"])), "s_pos int, scaler string")
    return search.candidates(scalers, search.heights(spark, 7000, 9799), 2)


@query("SELECT pos::INTEGER AS pos, (8400 + pos) / 10.0::DOUBLE AS height FROM (SELECT range AS pos FROM range(400)) WHERE list_contains(list_transform(range(16), lambda i: (2 * i + 1) * 400 // 32), pos)")
def stratified_heights(spark, read):
    return search.stratified(search.heights(spark, 8400, 8799), 400, 16)


@query("SELECT height, out_height::INTEGER AS out_height, round((out_height - height) / 2, 9) + 0.0 AS src_top, out_width::INTEGER AS out_width, round((out_width - width) / 2, 9) + 0.0 AS src_left, round(width, 9) + 0.0 AS src_width FROM (SELECT *, 1000 - 2 * floor((1000 - height) / 2) AS out_height, 1778 - 2 * floor((1778 - width) / 2) AS out_width FROM (SELECT height, height * 1778 / 1000 AS width FROM (SELECT (7000 + range) / 10.0::DOUBLE AS height FROM range(2800))))")
def centered_geometry(spark, read):
    g = search.centred(F.col("height"), 1778, 1000)
    return search.heights(spark, 7000, 9799).select("height", "*").select(F.col("height"), g["out_height"].alias("out_height"), _r(g["src_top"], 9).alias("src_top"), g["out_width"].alias("out_width"), _r(g["src_left"], 9).alias("src_left"), _r(g["src_width"], 9).alias("src_width"))


SIZES = [40.0, 43.5, 46.0, 48.0, 51.2, 54.0, 57.6, 60.0]


def _searched(read) -> DataFrame:
    return search.search(read("embeddings"), "embedding", search.GETNATIVE, SIZES, 64, ("vec_id",))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: _r(c, 4) for c in ("max_abs", "mae", "mse", "rmse", "psnr", "thresholded_mae", "fraction_over") if c in rows.columns})


@query()
def candidate_search(spark, read):
    """The best candidate of each signal, by mean error."""
    return stats.best(_searched(read), "mae", "idx", ("idx", "scaler", "size", "mae", "rmse", "thresholded_mae"), "vec_id")


@query()
def candidate_metrics(spark, read):
    return _searched(read)


@query()
def candidate_best_scaler(spark, read):
    means = _searched(read).groupBy("scaler", "family", "size").agg(F.min("idx").alias("idx"), F.avg("mae").alias("mae"))
    return stats.best(means, "mae", "idx", ("size", "mae"), "scaler", "family")


@query()
def candidate_best_family(spark, read):
    means = _searched(read).groupBy("scaler", "family", "size").agg(F.min("idx").alias("idx"), F.avg("mae").alias("mae"))
    return stats.best(stats.best(means, "mae", "idx", ("idx", "size", "mae"), "scaler", "family"), "mae", "idx", ("scaler", "size", "mae"), "family")


@query()
def candidate_ranks(spark, read):
    return stats.ranked(_searched(read).select("vec_id", "idx", "scaler", "size", "mae"), "mae", "idx", "rank", "vec_id")


# ---------------------------------------------------------------- statistics


@query("SELECT l_returnflag, count(*) AS n, round(median(l_extendedprice), 4) + 0.0 AS median, round(mad(l_extendedprice), 4) + 0.0 AS mad, quantile_disc(l_extendedprice, 0.95) AS p95, min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum FROM lineitem GROUP BY ALL")
def summarize(spark, read):
    return stats.summarize(read("lineitem"), "l_extendedprice", "l_returnflag").withColumns({"median": _r("median", 4), "mad": _r("mad", 4)})


@query("SELECT event_type, count(value) AS n, round(sum(value), 3) + 0.0 AS total, min(value) AS minimum, round(median(value), 6) + 0.0 AS median, round(avg(value), 6) + 0.0 AS mean, max(value) AS maximum FROM events GROUP BY ALL")
def totals(spark, read):
    return stats.totals(read("events"), "value", "event_type").withColumns({"total": _r("total", 3), "median": _r("median"), "mean": _r("mean")})


@query("SELECT l_linestatus, round(quantile_cont(l_quantity, 0.9), 6) + 0.0 AS percentile FROM lineitem GROUP BY ALL")
def percentile_linear(spark, read):
    return stats.percentile(read("lineitem"), "l_quantity", 0.9, "l_linestatus").withColumn("percentile", _r("percentile"))


@query("SELECT p_brand, CASE WHEN count(*) < 2 THEN 0.0 ELSE round(regr_slope(p_retailprice, p_size), 6) + 0.0 END AS slope FROM part GROUP BY ALL")
def slope(spark, read):
    return stats.slope(read("part"), "p_retailprice", "p_size", "p_brand").withColumn("slope", _r("slope"))


@query("SELECT phase, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM (SELECT o_totalprice, CASE WHEN k = 1 THEN 'cold' WHEN k <= 3 THEN 'warming' ELSE 'sustained' END AS phase FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)) GROUP BY ALL")
def phase_strata(spark, read):
    return stats.phases(read("orders"), "o_orderkey", "o_custkey").groupBy("phase").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("o_totalprice"), 2).alias("total"))


def _paired(read) -> DataFrame:
    """Mean price of finished and open orders of the customers that have both."""
    means = read("orders").where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("price"))
    whole = means.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("o_custkey")
    return stats.pairs(means.join(whole, "o_custkey", "left_semi"), "o_orderstatus", "F", "O", "price", "o_custkey")


_PAIRS = "WITH p AS (SELECT a.o_custkey, a.v AS control, b.v AS candidate, b.v / a.v AS ratio FROM (SELECT o_custkey, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) a JOIN (SELECT o_custkey, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) b USING (o_custkey)) "


@query(_PAIRS + "SELECT o_custkey, round(control, 7) + 0.0 AS control, round(candidate, 7) + 0.0 AS candidate, round(ratio, 6) + 0.0 AS ratio FROM p")
def paired_ratio(spark, read):
    return _paired(read).withColumns({"control": _r("control", 7), "candidate": _r("candidate", 7), "ratio": _r("ratio")})


@query(_PAIRS + "SELECT c_mktsegment, count(*) AS n, round(median(ratio), 6) + 0.0 AS median_of_ratios, round(median(candidate) / median(control), 6) + 0.0 AS ratio_of_medians, median(ratio) <= 1.0 AS passed FROM p JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def regression_gate(spark, read):
    rows = _paired(read).join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return stats.regression_gate(rows, 1.0, "c_mktsegment").withColumns({"median_of_ratios": _r("median_of_ratios"), "ratio_of_medians": _r("ratio_of_medians")})


@query()
def bootstrap_ci(spark, read):
    rows = _paired(read).join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return stats.bootstrap_median_ratio(rows, 1000, 20260101, "c_mktsegment")


@query("SELECT p_partkey, a - 1 AS old_rank, b - 1 AS new_rank, abs(b - a) AS rank_change FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS b FROM part)")
def rank_change(spark, read):
    return stats.rank_change(read("part"), "p_retailprice", "p_size", "p_partkey", "p_brand").select("p_partkey", "old_rank", "new_rank", "rank_change")


@query("SELECT p_brand, n, p_partkey, p_retailprice FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part) WHERE k = 1")
def argmin_group(spark, read):
    return stats.best(read("part"), "p_retailprice", "p_partkey", ("p_partkey", "p_retailprice"), "p_brand")


@query("SELECT l_returnflag, round(sum(l_extendedprice / l_quantity), 4) + 0.0 AS weighted_total, round(sum(l_extendedprice / l_quantity) / sum(1 / l_quantity), 6) + 0.0 AS weighted_mean FROM lineitem GROUP BY ALL")
def weighted_mean(spark, read):
    out = stats.weighted(read("lineitem"), F.col("l_extendedprice"), 1 / F.col("l_quantity"), "l_returnflag")
    return out.withColumns({"weighted_total": _r("weighted_total", 4), "weighted_mean": _r("weighted_mean")})


@query("SELECT l_returnflag AS flag, round(sum(l_extendedprice), 2) + 0.0 AS total, round(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (), 9) + 0.0 AS share FROM lineitem GROUP BY ALL")
def share_of_total(spark, read):
    return stats.share(read("lineitem").withColumnRenamed("l_returnflag", "flag"), "l_extendedprice", "flag").withColumns({"total": _r("total", 2), "share": _r("share", 9)})


@query("SELECT label, (s - 1)::INTEGER AS pos, round(sum(e::DOUBLE), 4) + 0.0 AS total FROM (SELECT label, generate_subscripts(embedding, 1) AS s, unnest(embedding) AS e FROM embeddings) GROUP BY ALL")
def array_element_sum(spark, read):
    e = read("embeddings")
    return stats.array_sum(e, "embedding", 64, "label").withColumn("total", _r("total", 4))


@query("SELECT p_brand, bool_and(good) AS accepted, count(*) FILTER (good) AS n_passing, coalesce(string_agg(p_type, ',' ORDER BY p_type) FILTER (good), '') AS passing FROM (SELECT p_brand, p_type, p_size > 2 AND p_retailprice >= 950 AS good FROM part) GROUP BY ALL")
def gate_acceptance(spark, read):
    return stats.accepted(read("part").withColumn("correct", F.col("p_size") > 2), "p_brand", "p_type", "correct", "p_retailprice", 950.0)


@query("SELECT user_id, min(a) AS attempt FROM (SELECT user_id, event_id % 3 AS a, min(value) AS low FROM events GROUP BY ALL) WHERE low >= 1.0 GROUP BY ALL")
def environment_valid(spark, read):
    return stats.environment_valid(read("events").withColumn("a", F.col("event_id") % 3), "value", "a", 1.0, "user_id")


@query("SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus)) = 1 AS agree FROM lineitem GROUP BY ALL")
def hash_agreement(spark, read):
    return stats.agree(read("lineitem"), ("l_returnflag", "l_linestatus"), "l_orderkey")


@query("SELECT o_custkey, CASE WHEN h = 0 THEN 'cpu' WHEN h = n THEN 'accelerated' ELSE 'mixed' END AS route FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS h FROM orders GROUP BY ALL)")
def route_label(spark, read):
    by = read("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("h"))
    return by.select("o_custkey", stats.route(F.col("n"), F.col("h")).alias("route"))


# ---------------------------------------------------------------- intervals and traces

#: Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session's time zone.
_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def _intervals(read) -> DataFrame:
    start = F.expr(_MICROS)
    return read("events").select("event_id", "event_type", "user_id", start.alias("start"), (start + F.floor(F.col("value") * 1_000_000)).cast("long").alias("end"))


_INTERVALS = "WITH t AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS start, epoch_us(ts) + floor(value * 1000000)::BIGINT AS stop FROM events), "


@query(_INTERVALS + """
m AS (SELECT *, max(stop) OVER (PARTITION BY event_type, user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t WHERE stop > start),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT event_type, user_id, sum(b - a)::BIGINT AS covered, count(*) AS n_islands FROM (SELECT event_type, user_id, island, min(start) AS a, max(stop) AS b FROM g GROUP BY ALL) GROUP BY ALL""")
def interval_union(spark, read):
    return intervals.union_length(_intervals(read), "start", "end", "event_type", "user_id")


@query(_INTERVALS + "e AS (SELECT event_type, start AS t, 1 AS d FROM t UNION ALL SELECT event_type, stop, -1 FROM t), r AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM e) SELECT event_type, max(level)::BIGINT AS peak FROM r GROUP BY ALL")
def peak_concurrency(spark, read):
    return intervals.peak_concurrency(_intervals(read), "start", "end", "event_type")


@query(_INTERVALS + "w AS (SELECT min(start) + 3600000000 AS a, min(start) + 7200000000 AS b FROM t) SELECT event_id, greatest(start, a) AS start, least(stop, b) AS \"end\" FROM t, w WHERE start < b AND stop > a")
def interval_clip(spark, read):
    rows = _intervals(read)
    first = rows.agg(F.min("start")).first()[0]
    return intervals.clipped(rows, "start", "end", first + 3600 * 1_000_000, first + 7200 * 1_000_000).select("event_id", "start", "end")


@query("SELECT user_id, min(epoch_us(ts)) FILTER (event_type = a) AS start, max(epoch_us(ts)) FILTER (event_type = b) AS \"end\" FROM events, (SELECT min(event_type) AS a, max(event_type) AS b FROM events) GROUP BY ALL HAVING max(epoch_us(ts)) FILTER (event_type = b) > min(epoch_us(ts)) FILTER (event_type = a)")
def begin_end_match(spark, read):
    e = read("events").withColumn("at", F.expr(_MICROS))
    first, last = e.agg(F.min("event_type"), F.max("event_type")).first()
    return intervals.matched(e, "user_id", "event_type", "at", first, last)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k BETWEEN 3 AND 7")
def skip_warmups(spark, read):
    return intervals.measured(read("events"), "event_id", 2, 5, "user_id").select("user_id", "event_id")


@query("SELECT o_custkey, o_orderkey, before AS expected FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE before <> o_orderkey")
def contiguity_gaps(spark, read):
    rows = read("orders").withColumn("stop", F.col("o_orderkey") + 1)
    return intervals.gaps(rows, "o_orderkey", "stop", "o_custkey").select("o_custkey", "o_orderkey", "expected")


# ---------------------------------------------------------------- joins, sets, groups


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def dedupe_last(spark, read):
    return read("events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))


@query("SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def semi_join(spark, read):
    big = read("orders").where("o_totalprice > 200000")
    return read("customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def anti_join(spark, read):
    big = read("orders").where("o_totalprice > 200000")
    return read("customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT n_name, r_name, count(*) AS n, round(sum(s_acctbal), 2) + 0.0 AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def keyed_assembly(spark, read):
    joined = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("s_acctbal"), 2).alias("balance"))


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) + 0.0 AS \"F\", round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) + 0.0 AS \"O\" FROM lineitem GROUP BY ALL")
def pivot(spark, read):
    return read("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(_r(F.sum("l_quantity"), 2))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def histogram(spark, read):
    return read("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT p_brand, p_type, count(*) AS n, min(p_retailprice) AS least FROM part GROUP BY ROLLUP (p_brand, p_type)")
def rollup_grains(spark, read):
    return read("part").rollup("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("least"))


@query("SELECT DISTINCT p_brand FROM part ORDER BY p_brand")
def sorted_distinct(spark, read):
    return read("part").select("p_brand").distinct().orderBy("p_brand")


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def key_intersection(spark, read):
    return read("customer").select(F.col("c_custkey").alias("k")).intersect(read("orders").select(F.col("o_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def key_difference(spark, read):
    return read("customer").select(F.col("c_custkey").alias("k")).exceptAll(read("orders").select(F.col("o_custkey").alias("k")).distinct())


@query("SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) ORDER BY n DESC, user_id LIMIT 12")
def top_users(spark, read):
    return read("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(12)


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY ALL")
def last_value(spark, read):
    return read("events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def digest_sha256(spark, read):
    return read("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("""
WITH b AS (SELECT p_partkey, list_concat([1469598103934665603::HUGEINT, (length(p_name) % 256)::HUGEINT, (length(p_name) // 256)::HUGEINT, 0, 0, 0, 0, 0, 0], list_transform(string_split(p_name, ''), lambda c: ord(c)::HUGEINT)) AS steps FROM part)
SELECT p_partkey, printf('%016x', list_reduce(steps, lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT) AS hash FROM b""")
def stable_hashes(spark, read):
    return read("part").select("p_partkey", digests.stable_hash_hex("p_name").alias("hash"))


_ORDERED = "(CASE WHEN ({0}::FLOAT::BIT)::INTEGER < 0 THEN -(({0}::FLOAT::BIT)::INTEGER::BIGINT & 2147483647) ELSE ({0}::FLOAT::BIT)::INTEGER::BIGINT END)"
_ULPS = f"abs({_ORDERED.format('l_discount')} - {_ORDERED.format('(l_discount * 3 / 3)')})"


@query(f"SELECT l_orderkey, l_linenumber, {_ULPS} AS ulps FROM lineitem")
def ulp_distances(spark, read):
    return read("lineitem").select("l_orderkey", "l_linenumber", digests.ulps(F.col("l_discount").cast("float"), (F.col("l_discount") * 3 / 3).cast("float")).alias("ulps"))


@query(f"SELECT l_returnflag, max({_ULPS.replace('* 3 / 3', '* 1.0000003')}) AS ulps FROM lineitem GROUP BY ALL")
def greatest_ulps(spark, read):
    rows = read("lineitem").withColumn("other", F.col("l_discount") * F.lit(1.0000003))
    return stats.greatest_ulps(rows, "l_discount", "other", "l_returnflag")


@query("""
WITH b AS (SELECT vec_id, list_transform(embedding::FLOAT[], lambda x: printf('%08x', ((x::BIT)::INTEGER::BIGINT & 4294967295))) AS words FROM embeddings)
SELECT vec_id, sha256(from_hex(array_to_string(list_transform(words, lambda w: w[7:8] || w[5:6] || w[3:4] || w[1:2]), ''))) AS digest FROM b""")
def plane_digest(spark, read):
    return clips.digest(read("embeddings"), "embedding", "vec_id")


@query("SELECT a.vec_id, round(list_avg(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 9) + 0.0 AS mae, list_max(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) AS max_abs FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def double_differences(spark, read):
    e = read("embeddings")
    both = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return clips.differences(both, "x", "y", "vec_id").withColumn("mae", _r("mae", 9))


# ---------------------------------------------------------------- errors, phases and sides


@query("""
WITH e AS (SELECT l_returnflag, l_extendedprice AS x, CASE l_linenumber WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE ELSE l_extendedprice * (1 + l_tax) END AS y FROM lineitem)
SELECT l_returnflag, round(max(abs(x - y)) FILTER (isfinite(y)), 6) + 0.0 AS maximum, round(sum(abs(x - y)) FILTER (isfinite(y)) / count(*), 6) + 0.0 AS mean, count(*) FILTER (NOT isfinite(y)) AS non_finite FROM e GROUP BY ALL""")
def error_stats(spark, read):
    n = F.col("l_linenumber")
    rows = read("lineitem").withColumn("y", F.when(n == 1, float("inf")).when(n == 2, float("nan")).otherwise(F.col("l_extendedprice") * (1 + F.col("l_tax"))))
    return stats.error_stats(rows, "l_extendedprice", "y", "l_returnflag").withColumns({"maximum": _r("maximum"), "mean": _r("mean")})


@query("SELECT event_type, max(abs(floor(value * 2.55)::BIGINT - floor(value)::BIGINT * 2)) AS codes FROM events GROUP BY ALL")
def greatest_code_difference(spark, read):
    rows = read("events").select("event_type", F.floor(F.col("value") * 2.55).alias("a"), (F.floor("value") * 2).alias("b"))
    return stats.greatest_difference(rows, "a", "b", "event_type")


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS total, min(l_quantity::BIGINT) AS minimum, median(l_quantity::BIGINT) AS median, round(avg(l_quantity::BIGINT), 9) + 0.0 AS mean, max(l_quantity::BIGINT) AS maximum, sum(l_quantity::BIGINT) / 12 AS total_per_batch, sum(l_quantity::BIGINT) / 96 AS total_per_frame FROM lineitem GROUP BY ALL")
def normalised_totals(spark, read):
    rows = read("lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    return stats.normalised_totals(rows, "q", {"batch": 12, "frame": 96}, "l_returnflag").withColumn("mean", _r("mean", 9))


_MEASURED = "WITH t AS (SELECT o_orderkey, unnest(['encode', 'solve', 'copy']) AS name, o_totalprice FROM orders) "


@query(_MEASURED + "SELECT name, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM t WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL")
def measured_phases(spark, read):
    names = ("encode", "solve", "copy")
    rows = read("orders").select("o_orderkey", "o_totalprice", F.explode(F.array(*map(F.lit, names))).alias("name"))
    own = stats.phases_of(rows, read("orders").where("o_orderstatus = 'F'"), "o_orderkey", "name", names)
    return own.groupBy("name").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) = ['F', 'O'] AS same FROM orders GROUP BY ALL")
def same_members(spark, read):
    return stats.same_members(read("orders"), "o_orderstatus", ("F", "O"), "o_custkey")


def _sides(read) -> DataFrame:
    """Mean price and first order of the customers that have finished and open orders, by status."""
    orders = read("orders").where(F.col("o_orderstatus").isin("F", "O"))
    sides = orders.groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("price"), F.min("o_orderkey").alias("first"))
    whole = sides.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("o_custkey")
    return sides.join(whole, "o_custkey", "left_semi").join(read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")


@query(_PAIRS + "SELECT c_mktsegment, round(median(control), 6) + 0.0 AS control, round(median(candidate), 6) + 0.0 AS candidate, round(median(control) / median(candidate), 6) + 0.0 AS speedup, count(*) AS n, round(median(control / candidate), 6) + 0.0 AS paired_median, round(mad(control / candidate), 6) + 0.0 AS paired_mad, round(quantile_disc(control / candidate, 0.95), 6) + 0.0 AS paired_p95, round(min(control / candidate), 6) + 0.0 AS paired_minimum, round(max(control / candidate), 6) + 0.0 AS paired_maximum FROM p JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def ab_summary(spark, read):
    out = stats.ab_summary(_sides(read), "o_orderstatus", "F", "O", "price", "o_custkey", "c_mktsegment")
    return out.withColumns({c: _r(c) for c in out.columns if c not in ("c_mktsegment", "n")})


@query(_PAIRS + "SELECT stratum, count(*) AS n, round(median(ratio), 6) + 0.0 AS median FROM p JOIN (SELECT o_custkey, CASE WHEN arg_min(o_orderstatus, o_orderkey) = 'F' THEN 'C-A' ELSE 'A-C' END AS stratum FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL) USING (o_custkey) GROUP BY ALL")
def order_strata(spark, read):
    return stats.order_strata(_sides(read), "o_orderstatus", "F", "O", "price", "first", "o_custkey").withColumn("median", _r("median"))


# ---------------------------------------------------------------- windows over time

_STAMP = "yyyy-MM-dd HH:mm:ss"


def _stamped(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"start": F.date_format("start", _STAMP), "end": F.date_format("end", _STAMP)})
    return rows.withColumn("total", _r("total", 4)) if "total" in rows.columns else rows


_WINDOW = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS start, strftime({0} + INTERVAL {1}, '%Y-%m-%d %H:%M:%S') AS \"end\""
_TUMBLING = f"SELECT {_WINDOW.format('w', '1 hour')}, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM (SELECT *, time_bucket(INTERVAL 1 hour, ts) AS w FROM events) GROUP BY ALL"


@query(_TUMBLING)
def tumbling_counts(spark, read):
    return _stamped(frames.windowed_counts(read("events"), "ts", "1 hour", None, None, "event_type"))


@query(f"SELECT {_WINDOW.format('w', '30 minutes')}, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM (SELECT *, time_bucket(INTERVAL 10 minutes, ts) - to_minutes(10 * s.range) AS w FROM events, range(3) s) GROUP BY ALL")
def sliding_counts(spark, read):
    return _stamped(frames.windowed_counts(read("events"), "ts", "30 minutes", "10 minutes"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 hours THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 2 hours, '%Y-%m-%d %H:%M:%S') AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, session""")
def session_counts(spark, read):
    return _stamped(frames.session_counts(read("events"), "ts", "2 hours", None, "user_id"))


@query(_TUMBLING)
def stream_tumbling(spark, read):
    """The tumbling counts by a stream over the table's files, run to its end."""
    source = read("events")
    stream = spark.readStream.schema(source.schema).parquet(_folder(source))
    name = f"tumbling_{uuid.uuid4().hex}"
    counts = frames.windowed_counts(stream, "ts", "1 hour", None, None, "event_type")
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return _stamped(spark.table(name))


def _folder(df: DataFrame) -> str:
    """A glob that matches the files of a table (a file source takes folders and globs)."""
    return df.inputFiles()[0][:-1] + "[" + df.inputFiles()[0][-1] + "]"


@query("SELECT event_type AS event_type, (k - 1) // 16 AS batch, count(*) AS n, count(*) = 16 AS \"full\" FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) GROUP BY ALL")
def count_batches(spark, read):
    return batcher.count_batches(read("events"), "event_type", "event_id", 16)


@query("SELECT a.event_id, count(DISTINCT b.user_id)::INTEGER AS callers FROM events a JOIN events b ON a.event_type = b.event_type AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 600000000 AND epoch_us(a.ts) GROUP BY ALL")
def recent_callers(spark, read):
    rows = read("events").withColumn("at", F.expr(_MICROS))
    return batcher.recent_callers(rows, "event_type", "user_id", "at", 600_000_000).select("event_id", "callers")


# ---------------------------------------------------------------- filters and gates


@query("SELECT event_id, event_type FROM events WHERE event_type LIKE 'p%' OR contains(event_type, 'ck')")
def label_filter(spark, read):
    return read("events").where(F.col("event_type").startswith("p") | F.contains(F.col("event_type"), F.lit("ck"))).select("event_id", "event_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def time_range(spark, read):
    at = F.col("o_orderdate")
    return read("orders").where((at >= F.expr("TIMESTAMP_NTZ'1995-01-01 00:00:00'")) & (at < F.expr("TIMESTAMP_NTZ'1996-01-01 00:00:00'"))).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_id % 4 = 1")
def shard(spark, read):
    return read("events").where(F.col("event_id") % 4 == 1).select("event_id")


@query("SELECT round(coalesce(sum(CASE WHEN l_returnflag = 'A' THEN 0 END), 0)::DOUBLE, 2) + 0.0::DOUBLE AS control_hits, round(sum(l_quantity) FILTER (l_returnflag <> 'A'), 2) + 0.0 AS candidate_hits, 0::BIGINT AS errors, min(l_tax) AS least_free, true AS passed FROM lineitem")
def evidence_gate(spark, read):
    control = F.col("l_returnflag") == "A"
    rows = read("lineitem").select(F.when(control, "control").otherwise("candidate").alias("variant"), F.when(control, 0.0).otherwise(F.col("l_quantity")).alias("hits"), F.lit(0).alias("errors"), F.col("l_tax").alias("free"))
    return stats.evidence_gate(rows, "variant", "hits", "errors", "free", 0.0).withColumns({"control_hits": _r("control_hits", 2), "candidate_hits": _r("candidate_hits", 2)})


@query("SELECT l_returnflag, l_linestatus, count(*) AS count, sum(l_quantity::BIGINT)::BIGINT AS ns, round(count(*) * 1e9 / sum(l_quantity::BIGINT), 3) + 0.0 AS per_second FROM lineitem GROUP BY ALL")
def throughput(spark, read):
    rows = read("lineitem").select("l_returnflag", "l_linestatus", F.lit(1).alias("one"), F.col("l_quantity").cast("long").alias("q"))
    return stats.throughput(rows, "one", "q", "l_returnflag", "l_linestatus").withColumn("per_second", _r("per_second", 3))


@query("SELECT l_returnflag, round(median(l_quantity) FILTER (l_linestatus = 'O') / median(l_quantity) FILTER (l_linestatus = 'F'), 6) + 0.0 AS speedup FROM lineitem GROUP BY ALL")
def speedups(spark, read):
    return stats.speedups(read("lineitem"), "l_linestatus", "F", "O", "l_quantity", "l_returnflag").withColumn("speedup", _r("speedup"))


@query("SELECT event_type, name, count(*) AS n, sum(value)::BIGINT AS total, max(value)::BIGINT AS greatest FROM (SELECT event_type, 'user' AS name, user_id AS value FROM events UNION ALL SELECT event_type, 'id', event_id FROM events) GROUP BY ALL")
def property_summary(spark, read):
    rows = read("events").select("event_type", F.create_map(F.lit("user"), F.col("user_id"), F.lit("id"), F.col("event_id")).alias("props"))
    return stats.properties(rows, "props", "event_type")


@query("SELECT p_partkey, round((0.25 - 0.25 * (p_size * 16) / 1920 + 0.5 * (p_size / 7.0))::DOUBLE, 9) + 0.0 AS shift, round((p_size * 16 * 0.5)::DOUBLE, 9) + 0.0 AS active FROM part")
def chroma_geometry(spark, read):
    """Window of a half-width chroma plane for a luma window of p_size * 16 samples at p_size / 7."""
    wide = F.col("p_size") * 16
    return read("part").select("p_partkey", _r(F.lit(0.25) - F.lit(0.25) * wide / 1920 + F.col("p_size") / F.lit(7.0) * 0.5, 9).alias("shift"), _r(wide * F.lit(0.5), 9).alias("active"))


@query("SELECT event_id, coalesce(r, c, 1) = 1 AS is_full FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 2 END AS r, CASE WHEN event_id % 5 = 0 THEN event_id % 2 END AS c FROM events)")
def frame_range(spark, read):
    """_Range before _ColorRange; neither: the RGB default."""
    from refold.functions.numbers import is_full_range_column

    e = F.col("event_id")
    props = F.map_from_entries(F.filter(F.array(F.when(e % 3 == 0, F.struct(F.lit("_Range"), e % 2)), F.when(e % 5 == 0, F.struct(F.lit("_ColorRange"), e % 2))), lambda x: x.isNotNull()))
    return read("events").select("event_id", is_full_range_column(props, True).alias("is_full"))
