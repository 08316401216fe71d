"""Confidence intervals by resampling, water years, autocorrelation.

Draws are generated, never shuffled: draw number i of replicate b of a series is a hash of (seed, series, b, i). Whole-group
resampling works on sums per group, so its cost is rows + replicates x groups, whatever the size of a group; resampling of
single values counts how often each place of a series is drawn and joins the counts with the values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sealwork.constants import DEGRADED_VALID_FRAC, LOW_N_GROUPS, MIN_LAG1_PAIRS, MIN_REPLICATES, NAN_CI_VALID_FRAC


def _nan() -> Column:
    return F.lit(float("nan"))


def water_year(d: Column) -> Column:
    """Year in which the water year of a date ends; it begins on 1 October. Takes dates and zoneless timestamps as they stand on the clock."""
    return F.year(d) + (F.month(d) >= 10).cast("int")


def default_block_size(n: Column) -> Column:
    """At least 5, else the cube root of n, half to even."""
    return F.greatest(F.lit(5), F.rint(F.pow(n.cast("double"), F.lit(1.0 / 3.0))).cast("int"))


def draw(seed: Column, n: Column, *key: Column) -> Column:
    """A number from 0 to n - 1 for a key: 48 bits of its SHA-256 modulo n, the same in every engine."""
    text = F.concat_ws(":", seed.cast("string"), *[k.cast("string") for k in key])
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint"), n.cast("bigint"))


def _check(replicates: int, ci: float) -> tuple[float, float]:
    if replicates < MIN_REPLICATES:
        raise ValueError(f"at least {MIN_REPLICATES} replicates")
    if not 0 < ci < 1:
        raise ValueError("ci lies between 0 and 1")
    return (1 - ci) / 2, 1 - (1 - ci) / 2


def _bounds(v: Column, lo: float, hi: float) -> Column:
    return F.percentile(v, F.array(F.lit(lo), F.lit(hi)))


def _flags(df: DataFrame, replicates: int) -> DataFrame:
    """Adds valid_frac, ci_degraded, ci_reason, low_n to (value, ci, n_valid, n_groups); intervals that tell nothing become NaN."""
    bad = F.coalesce(F.isnan("value") | F.col("value").isNull() | (F.abs("value") == float("inf")), F.lit(True))
    frac = F.col("n_valid") / replicates
    few = frac < NAN_CI_VALID_FRAC
    count = F.concat(F.lit("only "), F.col("n_valid").cast("string"), F.lit(f" of {replicates} replicates were finite"))
    df = df.withColumn("valid_frac", frac).withColumn("ci_degraded", bad | (frac < DEGRADED_VALID_FRAC))
    df = df.withColumn("ci_reason", F.when(bad, "point estimate is not finite").when(few | F.col("ci_degraded"), count).otherwise(""))
    for i, name in enumerate(("ci_low", "ci_high")):
        df = df.withColumn(name, F.when(bad | few, _nan()).otherwise(F.coalesce(F.col("ci")[i], _nan())))
    return df.withColumn("low_n", F.col("n_groups") < LOW_N_GROUPS).drop("ci")


def grouped_ratio_ci(
    df: DataFrame, series: list[str], group: str, metrics: dict[str, tuple[str, str]], replicates: int = 2000, ci: float = 0.9, seed: int = 0, min_groups: int = 10
) -> DataFrame:
    """Intervals of ratios of sums by resampling whole groups with replacement, one row per series and metric.

    metrics: name -> (numerator, denominator) column; the mean of x is (x, a column of ones). All metrics share the draws of a
    replicate. Rows with a null group are refused; null values count as 0 in sums. Replicates that are not finite are dropped
    and counted. A series of fewer than ``min_groups`` groups gets a row with NaN bounds and the reason. Columns: series, metric, value,
    ci_low, ci_high, n, n_groups, n_valid, valid_frac, ci_degraded, ci_reason, low_n. An empty table gives none.
    """
    lo, hi = _check(replicates, ci)
    if min_groups < 2:
        raise ValueError("at least 2 groups")
    sums = [F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_{part}_{m}") for m, (a, b) in metrics.items() for part, c in (("a", a), ("b", b))]
    named = df.withColumn(group, F.when(F.col(group).isNull(), F.raise_error(F.lit("a group label is null"))).otherwise(F.col(group)))
    parts = named.groupBy(*series, group).agg(*sums, F.count("*").alias("_n"))
    parts = parts.withColumn("_k", F.row_number().over(W.partitionBy(*series).orderBy(group)) - 1)
    total = parts.groupBy(*series).agg(*[F.sum(f"_{p}_{m}").alias(f"_{p}_{m}") for m in metrics for p in "ab"], F.sum("_n").alias("n"), F.count("*").alias("n_groups"))
    name = F.concat_ws("|", *[F.col(s).cast("string") for s in series]) if series else F.lit("")
    reps = total.where(F.col("n_groups") >= min_groups).select(*series, "n_groups", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_r"))
    reps = reps.withColumn("_i", F.explode(F.sequence(F.lit(0), (F.col("n_groups") - 1).cast("int"))))
    reps = reps.select(*series, "_r", draw(F.lit(seed), F.col("n_groups"), name, F.col("_r"), F.col("_i")).cast("int").alias("_k"))
    times = reps.groupBy(*series, "_r", "_k").agg(F.count("*").alias("_t"))
    sampled = times.join(parts.drop(group), [*series, "_k"]).groupBy(*series, "_r").agg(*[F.sum(F.col(f"_{p}_{m}") * F.col("_t")).alias(f"_{p}_{m}") for m in metrics for p in "ab"])
    ratio = lambda m: F.try_divide(F.col(f"_a_{m}"), F.col(f"_b_{m}"))
    long = lambda t, *more: t.select(*series, *more, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), ratio(m).alias("v")) for m in metrics])).alias("_x")).select(*series, *more, "_x.metric", "_x.v")
    finite = F.when(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    bounds = long(sampled).groupBy(*series, "metric").agg(_bounds(finite, lo, hi).alias("ci"), F.count(finite).alias("n_valid"))
    points = long(total, "n", "n_groups").withColumnRenamed("v", "value")
    out = points.join(bounds, [*series, "metric"], "left").withColumn("value", F.coalesce("value", _nan())).withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    out = _flags(out, replicates)
    few = F.col("n_groups") < min_groups
    reason = F.concat(F.lit(f"at least {min_groups} groups are needed, there are "), F.col("n_groups").cast("string"))
    return out.withColumn("ci_reason", F.when(few, reason).otherwise(F.col("ci_reason"))).select(
        *series, "metric", "value", "ci_low", "ci_high", "n", "n_groups", "n_valid", "valid_frac", "ci_degraded", "ci_reason", "low_n"
    )


def _placed(df: DataFrame, series: list[str], order: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Values that are no NaN with their place in the series, and sizes."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = rows.select(*series, F.col(value).cast("double").alias("_v"), (F.row_number().over(W.partitionBy(*series).orderBy(*order)) - 1).alias("_p"))
    return rows, rows.groupBy(*series).agg(F.count("*").alias("n"))


def _resampled(rows: DataFrame, sizes: DataFrame, drawn: DataFrame, series: list[str], stats: dict[str, Callable[[Column, Column], Column]], lo: float, hi: float, replicates: int, method: str) -> DataFrame:
    times = drawn.groupBy(*series, "_r", "_p").agg(F.count("*").alias("_t"))
    values = times.join(rows, [*series, "_p"]).groupBy(*series, "_r").agg(*[f(F.col("_v"), F.col("_t")).alias(k) for k, f in stats.items()])
    points = rows.groupBy(*series).agg(*[f(F.col("_v"), F.lit(1)).alias(k) for k, f in stats.items()])
    long = lambda t: t.select(*series, F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("v")) for k in stats])).alias("_x")).select(*series, "_x.metric", "_x.v")
    # a NaN is part of the sample here: one poisons both bounds; only failures are left out
    ci = long(values).groupBy(*series, "metric").agg(_bounds(F.col("v"), lo, hi).alias("ci"), F.coalesce(F.bool_or(F.isnan("v")), F.lit(False)).alias("_nan"), F.count("v").alias("n_valid"))
    poor = F.col("_nan") | (F.col("n_valid") < 10)
    out = long(points).withColumnRenamed("v", "value").join(ci, [*series, "metric"], "left").join(sizes, series if series else F.lit(True))
    return out.select(
        *series, "metric", F.coalesce("value", _nan()).alias("value"), *[F.when(poor | F.col("ci").isNull(), _nan()).otherwise(F.col("ci")[i]).alias(c) for i, c in enumerate(("ci_low", "ci_high"))],
        F.lit(method).alias("method"), "n", F.coalesce("n_valid", F.lit(0)).alias("n_valid"),
    )


def mean_stat(v: Column, t: Column) -> Column:
    """Mean of values v drawn t times each."""
    return F.try_divide(F.sum(v * t), F.sum(t).cast("double"))


def std_stat(v: Column, t: Column) -> Column:
    """Population standard deviation of values v drawn t times each."""
    m = F.try_divide(F.sum(v * v * t), F.sum(t).cast("double")) - F.pow(mean_stat(v, t), F.lit(2.0))
    return F.sqrt(F.greatest(m, F.lit(0.0)))


def bootstrap_ci(df: DataFrame, series: list[str], order: list[str], value: str, stats: dict[str, Callable[[Column, Column], Column]], replicates: int = 500, ci: float = 0.9, seed: int = 0) -> DataFrame:
    """Intervals by drawing single values with replacement. Series of fewer than 5 values that are no NaN get no row."""
    lo, hi = _check(replicates, ci)
    rows, sizes = _placed(df, series, order, value)
    sizes = sizes.where("n >= 5")
    name = F.concat_ws("|", *[F.col(s).cast("string") for s in series]) if series else F.lit("")
    drawn = sizes.select(*series, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_r")).withColumn("_i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    drawn = drawn.select(*series, "_r", draw(F.lit(seed), F.col("n"), name, F.col("_r"), F.col("_i")).cast("int").alias("_p"))
    return _resampled(rows, sizes, drawn, series, stats, lo, hi, replicates, "bootstrap_iid")


def block_bootstrap_ci(
    df: DataFrame, series: list[str], order: list[str], value: str, stats: dict[str, Callable[[Column, Column], Column]], replicates: int = 500, ci: float = 0.9, seed: int = 0, block: int | None = None
) -> DataFrame:
    """Intervals by drawing blocks of consecutive values that wrap round the end. Series of fewer than 10 values get no row."""
    lo, hi = _check(replicates, ci)
    rows, sizes = _placed(df, series, order, value)
    size = default_block_size(F.col("n")) if block is None else F.lit(block)
    sizes = sizes.where("n >= 10").withColumn("_b", F.greatest(F.lit(1), F.least(size, F.col("n").cast("int"))))
    name = F.concat_ws("|", *[F.col(s).cast("string") for s in series]) if series else F.lit("")
    blocks = sizes.select(*series, "n", "_b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_r")).withColumn("_i", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / F.col("_b")) - 1).cast("int"))))
    blocks = blocks.withColumn("_s", draw(F.lit(seed), F.col("n"), name, F.col("_r"), F.col("_i"))).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    drawn = blocks.where(F.col("_i") * F.col("_b") + F.col("_o") < F.col("n")).select(*series, "_r", F.pmod(F.col("_s") + F.col("_o"), F.col("n")).cast("int").alias("_p"))
    return _resampled(rows, sizes.drop("_b"), drawn, series, stats, lo, hi, replicates, "bootstrap_block")


def lag1_autocorrelation(df: DataFrame, series: list[str], year: str, value: str, high: float = 0.3) -> DataFrame:
    """Pearson correlation of yearly means with those of the year after; years on both sides of a gap are no pair.

    One row per series: r1 (NaN below 8 pairs or without variance), n_years, n_pairs, has_gaps, low_n, high. NaN values count nothing.
    """
    v = F.col(value).cast("double")
    good = F.when(v.isNotNull() & ~F.isnan(v), v)
    by = df.groupBy(*series, F.col(year).alias("_y")).agg(F.avg(good).alias("_m"))
    span = by.groupBy(*series).agg((F.max("_y") - F.min("_y") + 1).alias("_span"), F.count("_m").alias("n_years"))
    pair = by.where("_m is not null").withColumn("_b", F.lead("_m").over(W.partitionBy(*series).orderBy("_y"))).withColumn("_g", F.lead("_y").over(W.partitionBy(*series).orderBy("_y")) - F.col("_y"))
    pair = pair.where("_g = 1").select(*series, F.col("_m").alias("_a"), "_b")
    mean = pair.groupBy(*series).agg(F.avg("_a").alias("_ma"), F.avg("_b").alias("_mb"), F.count("*").alias("n_pairs"))
    a, b = F.col("_a") - F.col("_ma"), F.col("_b") - F.col("_mb")
    on = series if series else F.lit(True)
    prod = pair.join(mean, on).groupBy(*series).agg(F.sum(a * b).alias("_ab"), F.sum(a * a).alias("_aa"), F.sum(b * b).alias("_bb"), F.max("n_pairs").alias("n_pairs"))
    out = span.join(prod, on, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    r = F.try_divide(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb")))
    out = out.withColumn("r1", F.when(F.col("n_pairs") >= MIN_LAG1_PAIRS, F.coalesce(r, _nan())).otherwise(_nan()))
    return out.select(*series, "r1", "n_years", "n_pairs", (F.col("n_years") < F.col("_span")).alias("has_gaps"), (F.col("n_pairs") < MIN_LAG1_PAIRS).alias("low_n"), (~F.isnan("r1") & (F.col("r1") >= high)).alias("high"))


def grouped_bootstrap_fn(df: DataFrame, series: str, group: str, values: list[str], fn: Callable[[pd.DataFrame], float], replicates: int = 2000, ci: float = 0.9, seed: int = 0) -> DataFrame:
    """Whole-group intervals of any statistic of a pandas frame, for statistics that no sums express; numpy's own generator draws.

    One task holds one series. Replicates that raise or are not finite are dropped and counted.
    """
    lo, hi = _check(replicates, ci)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members = [g.index.to_numpy() for _, g in pdf.reset_index(drop=True).groupby(group, sort=True)]
        frame, rng, got = pdf.reset_index(drop=True), np.random.default_rng(seed), []

        def value(rows: np.ndarray) -> float:
            try:
                return float(fn(frame.iloc[rows]))
            except Exception:
                return float("nan")

        for _ in range(replicates):
            v = value(np.concatenate([members[j] for j in rng.integers(0, len(members), size=len(members))]))
            if np.isfinite(v):
                got.append(v)
        return pd.DataFrame({"series": [str(frame[series].iloc[0])], "value": [value(np.arange(len(frame)))], "ci": [np.quantile(got, [lo, hi]).tolist() if got else None], "n": [len(frame)], "n_groups": [len(members)], "n_valid": [len(got)]})

    out = df.select(series, group, *values).groupBy(series).applyInPandas(run, "series string, value double, ci array<double>, n bigint, n_groups bigint, n_valid bigint")
    return _flags(out, replicates)
