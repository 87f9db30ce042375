"""Statistics of measurements: summaries, pairs, slopes, gates, ranks, bootstrap."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refold.functions import digests


def _key(keys: tuple[str, ...]) -> list[Column]:
    return [F.col(k) for k in keys]


def summarize(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, median, mad (median distance from the median), p95 (nearest rank), minimum, maximum."""
    medians = rows.groupBy(*keys).agg(F.median(value).alias("median"))
    joined = rows.join(medians, list(keys)) if keys else rows.crossJoin(F.broadcast(medians))
    p95 = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})")
    return joined.groupBy(*keys).agg(
        F.count(value).alias("n"), F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"), p95.alias("p95"), F.min(value).alias("minimum"), F.max(value).alias("maximum")
    )


def totals(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, total, minimum, median, mean, maximum."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("minimum"), F.median(v).alias("median"), F.avg(v).alias("mean"), F.max(v).alias("maximum"))


def normalised_totals(rows: DataFrame, value: str, counts: dict[str, int], *keys: str) -> DataFrame:
    """totals, and the total per batch, frame or whatever `counts` counts (null for a count of 0)."""
    return totals(rows, value, *keys).withColumns({f"total_per_{what}": F.try_divide("total", F.lit(n)) for what, n in counts.items()})


def error_stats(rows: DataFrame, reference: str, candidate: str, *keys: str) -> DataFrame:
    """maximum and mean of the absolute differences and non_finite, the number of candidates that are not
    finite: these add no difference, but count in the mean's divisor. No row with both values: 0."""
    c = F.col(candidate).cast("double")
    finite = ~F.isnan(c) & (F.abs(c) < float("inf"))
    error = F.when(finite, F.abs(F.col(reference).cast("double") - c))
    n = F.count_if(c.isNotNull() & F.col(reference).isNotNull())
    return rows.groupBy(*keys).agg(F.coalesce(F.max(error), F.lit(0.0)).alias("maximum"), F.coalesce(F.try_divide(F.sum(error), n), F.lit(0.0)).alias("mean"), F.count_if(~finite).alias("non_finite"))


def greatest_difference(rows: DataFrame, reference: str, candidate: str, *keys: str) -> DataFrame:
    """Greatest difference of two integer codes; 0 without any."""
    apart = F.abs(F.col(reference).cast("long") - F.col(candidate).cast("long"))
    return rows.groupBy(*keys).agg(F.coalesce(F.max(apart), F.lit(0)).alias("codes"))


def greatest_ulps(rows: DataFrame, reference: str, candidate: str, *keys: str) -> DataFrame:
    """Greatest distance in single-precision steps; 0 without any."""
    both = rows.where(F.col(reference).isNotNull() & F.col(candidate).isNotNull())
    steps = both.select(*keys, digests.ulps(F.col(reference).cast("float"), F.col(candidate).cast("float")).alias("ulps"))
    return steps.groupBy(*keys).agg(F.coalesce(F.max("ulps"), F.lit(0)).alias("ulps"))


def percentile(rows: DataFrame, value: str, p: float, *keys: str) -> DataFrame:
    """Linear between order statistics."""
    return rows.groupBy(*keys).agg(F.percentile(value, p).alias("percentile"))


def pairs(rows: DataFrame, variant: str, control: str, candidate: str, value: str, *keys: str) -> DataFrame:
    """One row for each key with the control's and the candidate's value and their ratio; a key without
    exactly one of each is an error when it is read."""
    is_ = lambda v: F.col(variant) == v
    wide = rows.where(F.col(variant).isin(control, candidate)).groupBy(*keys).agg(
        F.count_if(is_(control)).alias("a"), F.count_if(is_(candidate)).alias("b"), F.max(F.when(is_(control), F.col(value))).alias("control"), F.max(F.when(is_(candidate), F.col(value))).alias("candidate")
    )
    whole = F.assert_true((F.col("a") == 1) & (F.col("b") == 1), F.lit("incomplete pair")).isNull()
    return wide.where(whole).select(*keys, "control", "candidate", F.try_divide("candidate", "control").alias("ratio"))


def ab_summary(samples: DataFrame, variant: str, control: str, candidate: str, value: str, sample: str, *keys: str) -> DataFrame:
    """For each key the ratio of the variants' medians and the summary of the ratios sample by sample, both
    control by candidate (over 1: the candidate takes less). A sample without one of each is an error."""
    both = pairs(samples, variant, control, candidate, value, *keys, sample).withColumn("speedup", F.try_divide("control", "candidate"))
    whole = both.groupBy(*keys).agg(F.median("control").alias("control"), F.median("candidate").alias("candidate"))
    whole = whole.withColumn("speedup", F.try_divide("control", "candidate"))
    paired = summarize(both, "speedup", *keys)
    paired = paired.select(*keys, "n", *[F.col(c).alias(f"paired_{c}") for c in ("median", "mad", "p95", "minimum", "maximum")])
    return whole.join(paired, list(keys))


def order_strata(rows: DataFrame, variant: str, control: str, candidate: str, value: str, order: str, *keys: str) -> DataFrame:
    """Number and median of the pairs' ratios by which side came first: C-A (the control) or A-C."""
    first = rows.where(F.col(variant).isin(control, candidate)).groupBy(*keys).agg(F.min_by(variant, order).alias("first"))
    both = pairs(rows, variant, control, candidate, value, *keys).join(first, list(keys))
    return both.groupBy(F.when(F.col("first") == control, "C-A").otherwise("A-C").alias("stratum")).agg(F.count("ratio").alias("n"), F.median("ratio").alias("median"))


def phases_of(rows: DataFrame, batches: DataFrame, key: str, name: str, names: tuple[str, ...]) -> DataFrame:
    """The rows of the batches' keys. Unless the keys of batches are distinct and each of the names has as many
    rows as there are batches, reading it is an error. The counts are one row, which is joined as such."""
    own = rows.join(batches.select(key), key, "left_semi")
    n = batches.agg(F.count(F.lit(1)).alias("__n"), F.count_distinct(key).alias("__keys"))
    counts = own.agg(*[F.count_if(F.col(name) == x).alias(f"__{k}") for k, x in enumerate(names)]).crossJoin(F.broadcast(n))
    alike = F.lit(True)
    for c in ("__keys", *[f"__{k}" for k in range(len(names))]):
        alike &= F.col(c) == F.col("__n")
    return own.crossJoin(F.broadcast(counts.select(alike.alias("__alike")))).where(F.assert_true("__alike", F.lit("phases do not map one to one to batches")).isNull()).drop("__alike")


def same_members(rows: DataFrame, member: str, expected: tuple, *keys: str) -> DataFrame:
    """Whether the distinct members of each key are the expected ones: all of them and no other (null is one)."""
    inside = F.coalesce(F.col(member).isin(*expected), F.lit(False))
    found = F.count_distinct(F.when(inside, F.col(member)))
    return rows.groupBy(*keys).agg(((found == len(set(expected))) & (F.count_if(~inside) == 0)).alias("same"))


def slope(rows: DataFrame, y: str, x: str, *keys: str) -> DataFrame:
    """Least-squares slope of y on x, 0 for fewer than two rows."""
    return rows.groupBy(*keys).agg(F.when(F.count(y) < 2, 0.0).otherwise(F.regr_slope(y, x)).alias("slope"))


def phases(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """rows with `phase`: the first of each key is cold, the next two warming, the rest sustained."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("phase", F.when(n == 1, "cold").when(n <= 3, "warming").otherwise("sustained"))


def best(rows: DataFrame, value: str, order: str, columns: tuple[str, ...], *keys: str) -> DataFrame:
    """The row with the least value of each key; of equal ones the first by order."""
    row = F.min_by(F.struct(*columns), F.struct(value, order)).alias("row")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), row).select(*keys, "n", *[F.col(f"row.{c}").alias(c) for c in columns])


def ranked(rows: DataFrame, value: str, order: str, name: str, *keys: str) -> DataFrame:
    """rows with a 0-based rank by value; equal values keep the order."""
    w = Window.partitionBy(*keys).orderBy(value, order)
    return rows.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def rank_change(rows: DataFrame, old: str, new: str, order: str, *keys: str) -> DataFrame:
    both = ranked(ranked(rows, old, order, "old_rank", *keys), new, order, "new_rank", *keys)
    return both.withColumn("rank_change", F.abs(F.col("new_rank") - F.col("old_rank")))


def weighted(rows: DataFrame, value: Column, weight: Column, *keys: str) -> DataFrame:
    """Weighted total and mean; the divisor is 1 where there is no weight."""
    total, w = F.sum(value * weight), F.sum(weight)
    return rows.groupBy(*keys).agg(total.alias("weighted_total"), (total / F.when(F.coalesce(w, F.lit(0)) == 0, 1.0).otherwise(w)).alias("weighted_mean"))


def share(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Each key's total and its share of all. The grand total is one row and is joined as such."""
    by = rows.groupBy(*keys).agg(F.sum(value).alias("total"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("total").alias("all")))).select(*keys, "total", F.try_divide("total", "all").alias("share"))


def array_sum(rows: DataFrame, column: str, width: int, *keys: str) -> DataFrame:
    """Element-wise sums of arrays of one length, as rows (pos, total)."""
    sized = rows.where(F.assert_true(F.size(column) == width, F.lit("counter arrays differ in length")).isNull())
    return sized.select(*keys, F.posexplode(column).alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum(F.col("v").cast("double")).alias("total"))


def regression_gate(pairs_: DataFrame, limit: float, *keys: str) -> DataFrame:
    """Median of the ratios and ratio of the medians, and whether the first stays within the limit."""
    by = pairs_.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median("ratio").alias("median_of_ratios"), F.try_divide(F.median("candidate"), F.median("control")).alias("ratio_of_medians"))
    return by.withColumn("passed", F.coalesce(F.col("median_of_ratios") <= limit, F.lit(False)))


def accepted(cases: DataFrame, group: str, name: str, correct: str, lower: str, gate: float) -> DataFrame:
    """A group is accepted if all its cases are correct and their lower bounds reach the gate."""
    good = F.col(correct) & (F.col(lower) >= gate)
    return cases.groupBy(group).agg(F.bool_and(good).alias("accepted"), F.count_if(good).alias("n_passing"), F.array_join(F.sort_array(F.collect_list(F.when(good, F.col(name)))), ",").alias("passing"))


def environment_valid(samples: DataFrame, idle: str, attempt: str, least: float, *keys: str) -> DataFrame:
    """The first attempt of each key whose samples are all idle enough; a missing reading fails it."""
    by = samples.groupBy(*keys, attempt).agg(F.min(idle).alias("low"), F.count_if(F.col(idle).isNull()).alias("missing"))
    return by.where((F.col("low") >= least) & (F.col("missing") == 0)).groupBy(*keys).agg(F.min(attempt).alias("attempt"))


def agree(rows: DataFrame, parts: tuple[str, ...], *keys: str) -> DataFrame:
    """Whether all rows of a key have equal parts."""
    return rows.groupBy(*keys).agg((F.countDistinct(F.struct(*parts)) == 1).alias("agree"))


def route(n: Column, hits: Column) -> Column:
    return F.when(hits == 0, "cpu").when(hits == n, "accelerated").otherwise("mixed")


def bootstrap_median_ratio(pairs_: DataFrame, resamples: int, seed: int, *keys: str) -> DataFrame:
    """Median ratio and the 2.5 and 97.5 % percentiles of its bootstrap by resampled pairs. Each key's
    generator is seeded by the key, so a repeat gives the same numbers.
    Which ranks are in the middle of a resample depends on the number of pairs only. They are drawn from
    their distribution (order statistics of uniform numbers) and looked up among the ranked ratios, so no
    task holds a key's pairs. Null ratios are left out."""
    rows = pairs_.where("ratio IS NOT NULL").select(*keys, "ratio")
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median("ratio").alias("median"))
    draw = F.udf(lambda key, n: middle_ranks(random.Random(f"{seed}:{key}"), n, resamples), "array<array<bigint>>")
    drawn = whole.select(*[F.col(k).alias(f"_{k}") for k in keys], F.posexplode(draw(F.to_json(F.struct(*keys)), "n")).alias("_draw", "_ranks"))
    picks = drawn.withColumn("_rank", F.explode("_ranks")).drop("_ranks")
    ranked = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("ratio")))
    own = lambda: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    medians = ranked.join(picks, [F.col("_at") == F.col("_rank"), *own()]).groupBy(*[f"_{k}" for k in keys], "_draw").agg(F.avg("ratio").alias("m"))
    at = lambda p: F.percentile("m", F.lit(p))
    bounds = medians.groupBy(*[f"_{k}" for k in keys]).agg(at(0.025).alias("lower"), at(0.975).alias("upper"))
    return whole.join(bounds, own()).select(*keys, "n", "median", "lower", "upper")


def middle_ranks(rng: random.Random, n: int, resamples: int) -> list[list[int]]:
    """Ranks (from 1) of the two middle values, twice the same for odd n, of each resample of n from n."""
    out, k = [], (n + 1) // 2
    for _ in range(resamples):
        low = high = rng.betavariate(k, n - k + 1)
        if n % 2 == 0:
            high = low + (1 - low) * rng.betavariate(1, n - k)
        out.append([min(n, int(n * x) + 1) for x in (low, high)])
    return out


def evidence_gate(runs: DataFrame, variant: str, hits: str, errors: str, free: str, least_free: float) -> DataFrame:
    """One row of sums over all runs, and whether the control stayed unused, the candidate was used, nothing
    failed and memory stayed free."""
    of = lambda v, c: F.coalesce(F.sum(F.when(F.col(variant) == v, F.col(c))), F.lit(0)).cast("double")
    by = runs.agg(of("control", hits).alias("control_hits"), of("candidate", hits).alias("candidate_hits"), F.sum(errors).alias("errors"), F.min(free).alias("least_free"))
    return by.withColumn("passed", (F.col("control_hits") == 0) & (F.col("candidate_hits") > 0) & (F.col("errors") == 0) & (F.col("least_free") >= least_free))


def throughput(rows: DataFrame, count: str, nanoseconds: str, *keys: str) -> DataFrame:
    """Batches combined: summed counts and times, and the rate; null without time."""
    by = rows.groupBy(*keys).agg(F.sum(count).alias("count"), F.sum(nanoseconds).alias("ns"))
    return by.withColumn("per_second", F.try_divide(F.col("count") * 1e9, F.col("ns")))


def speedups(rates: DataFrame, variant: str, old: str, new: str, rate: str, *keys: str) -> DataFrame:
    """Ratio of the variants' median rates; null where one is missing."""
    m = lambda v: F.median(F.when(F.col(variant) == v, F.col(rate)))
    return rates.groupBy(*keys).agg(F.try_divide(m(new), m(old)).alias("speedup"))


def properties(rows: DataFrame, props: str, *keys: str) -> DataFrame:
    """Number, sum and greatest value of each property of a map column."""
    each = rows.select(*keys, F.explode(props).alias("name", "value"))
    return each.groupBy(*keys, "name").agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.max("value").alias("greatest"))
