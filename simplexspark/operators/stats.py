"""Profiles, contingency counts, box-plot statistics and agreement measures."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplexspark.functions.scalars import count_observed, nan_to_null, observed
from simplexspark.operators.joins import null_safe_join
from simplexspark.operators.quantiles import exact_quantiles
from simplexspark.operators.reshape import unpivot


def _column_stats(df: DataFrame, cols: Sequence[str], stats: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per column from one wide aggregate: the rows themselves are never unpivoted."""
    row = df.agg(*[f(F.col(c)).alias(f"{c}__{name}") for c in cols for name, f in stats.items()])
    cells = [F.struct(F.lit(c).alias("variable"), *[F.col(f"`{c}__{name}`").alias(name) for name in stats]) for c in cols]
    return row.select(F.inline(F.array(*cells)))


def _column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    return exact_quantiles(unpivot(df, [], cols), ["variable"], "value", probs, names)


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: n, n_missing, pct_missing, mean, median, sd, min, max. NaN counts as missing."""
    df = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    moments = _column_stats(df, cols, {
        "n": F.count, "n_missing": lambda c: F.count_if(c.isNull()),
        "pct_missing": lambda c: F.avg(c.isNull().cast("double")) * 100,
        "mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max})
    med = _column_quantiles(df, cols, [0.5], ["median"])
    return (moments.join(med, "variable", "left")
            .select("variable", "n", "n_missing", "pct_missing", "mean", "median", "sd", "min", "max")
            .orderBy(F.desc("n"), "variable"))


def summary_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min, Q1, Median, Mean, Q3, Max and SD of each column over its values that are neither null nor NaN."""
    df = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    moments = _column_stats(df, cols, {"min": F.min, "mean": F.avg, "max": F.max, "sd": F.stddev_samp})
    qs = _column_quantiles(df, cols, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    return (moments.join(qs, "variable", "left")
            .select("variable", "min", "q1", "median", "mean", "q3", "max", "sd"))


def contingency(df: DataFrame, rows: str, cols: str | None = None, levels: Sequence[str] | None = None) -> DataFrame:
    """One- or two-way counts, nulls left out. With ``levels`` the second way is spread to
    columns and empty cells are 0."""
    keys = [rows] + ([cols] if cols else [])
    known = df.dropna(subset=keys)
    if levels is None:
        return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return known.groupBy(rows).agg(*[F.count_if(F.col(cols) == lv).alias(str(lv)) for lv in levels])


def shares(df: DataFrame, group: Sequence[str], category: str) -> DataFrame:
    """Count of each category and its share of the group. The window runs over the already
    counted rows, one per category."""
    counts = df.groupBy(*group, category).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("prop", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def rate(df: DataFrame, group: Sequence[str], flag: str, name: str = "pct") -> DataFrame:
    """100 x share of rows whose 0/1 flag is 1, nulls skipped."""
    return df.groupBy(*group).agg((F.avg((F.col(flag) == 1).cast("double")) * 100).alias(name))


def mean_by(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of several columns by group in long form. Aggregated wide, then unpivoted: the
    long table has one row per group and variable, never one per input row."""
    wide = df.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])
    return unpivot(wide, by, values)


def box_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whisker ends (extreme values within 1.5 IQR of the box) and outlier count. Null and
    NaN are left out."""
    known = df.withColumn(value, nan_to_null(F.col(value).cast("double"))).filter(F.col(value).isNotNull())
    box = exact_quantiles(known, by, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col(value) >= F.col("q1") - 1.5 * iqr) & (F.col(value) <= F.col("q3") + 1.5 * iqr)
    joined = null_safe_join(known.select(*by, value), box, by).select(
        *by, F.col(value).alias("__v"), inside.alias("__in"), "q1", "median", "q3")
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), F.min(F.when(F.col("__in"), F.col("__v"))).alias("lower"),
        F.max(F.when(F.col("__in"), F.col("__v"))).alias("upper"), F.count_if(~F.col("__in")).alias("n_outliers"))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact number of distinct non-null values per column, one row: each column is made distinct
    on its own, so values collapse before the shuffle and rows are not repeated per column."""
    counts = None
    for c in cols:
        one = df.select(c).dropna().distinct().agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.lit(c))
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(*[F.max(F.when(F.col("c") == c, F.col("n"))).alias(c) for c in cols])


def distinct_sketches(df: DataFrame, by: Sequence[str], cols: Sequence[str], lg_k: int = 12) -> DataFrame:
    """One HyperLogLog sketch per group and column, to be stored and merged later: <column>_sketch. A sketch takes 2^lg_k bytes
    at most whatever the group's size; its standard error is about 1 / sqrt(2^lg_k), 1.6 % by default."""
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(c, lg_k).alias(f"{c}_sketch") for c in cols])


def merged_counts(sketches: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Approximate distinct counts of coarser groups from stored sketches, without reading the rows again. The merge of sketches
    is the sketch of the union, so values that several groups share count once."""
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(c) for c in cols])


def extent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("min", F.min), ("max", F.max))])


def concordance(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson r and RMSE over all cells of paired columns."""
    cells = F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs]))
    long = df.select(cells.alias("c")).select("c.a", "c.b").dropna()
    return long.agg(F.corr("a", "b").alias("r"), F.sqrt(F.avg((F.col("a") - F.col("b")) ** 2)).alias("rmse"),
                    F.count(F.lit(1)).alias("n"))


def score(df: DataFrame, obs: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Hold-out r, RMSE and MAE over complete pairs."""
    err = F.col(pred) - F.col(obs)
    return df.dropna(subset=[obs, pred]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr(obs, pred).alias("r"),
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"))


def n_observed(df: DataFrame, parts: Sequence[str], name: str = "n_observed") -> DataFrame:
    return df.withColumn(name, count_observed(parts))


def flag_imputed(before: DataFrame, key: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Provenance of every cell: key, part, Original or Imputed."""
    flags = [F.when(observed(p), F.lit("Original")).otherwise(F.lit("Imputed")).alias(p) for p in parts]
    return unpivot(before.select(*key, *flags), key, parts, "part", "origin")
