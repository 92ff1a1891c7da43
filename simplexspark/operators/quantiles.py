"""Exact grouped quantiles (linear interpolation between order statistics) in two scans.

1. A rank summary of every group (``percentile_approx``: partial summaries are merged, and the rank of what it returns
   is off by n / accuracy at most) brackets each wanted rank. The bracket is set three errors to either side, so it holds the
   rank by proof, and 6 n / accuracy rows and their ties at most. A group of up to ``accuracy`` rows is bracketed whole.
2. Rows are counted: those inside a bracket by value, those between two brackets together. Counts are added up before they are
   shuffled; running totals over what is left give the values at the wanted ranks.

All groups and probabilities share both scans, whatever a group's size. Null and NaN are missing values; infinite ones are
data.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplexspark.functions.scalars import nan_to_null
from simplexspark.operators.joins import null_safe_join

ACCURACY = 10_000


def _values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.select(*by, nan_to_null(F.col(value).cast("double")).alias("__v")).filter(F.col("__v").isNotNull())


def _brackets(rows: DataFrame, by: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """One row per group: its number of rows __n and the ends __lo, __hi of each probability's bracket."""
    margin = 3 / accuracy
    ends = [e for p in probs for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", ends, accuracy).alias("__e"))
    small = F.col("__n") <= accuracy
    lo = [F.when(small | F.lit(p <= margin), F.lit(-math.inf)).otherwise(F.col("__e")[2 * i]) for i, p in enumerate(probs)]
    hi = [F.when(small | F.lit(p >= 1 - margin), F.lit(math.inf)).otherwise(F.col("__e")[2 * i + 1]) for i, p in enumerate(probs)]
    return found.select(*by, "__n", F.array(*lo).alias("__lo"), F.array(*hi).alias("__hi"))


def _values_at(rows: DataFrame, by: Sequence[str], probs: Sequence[float], ranks: Mapping[str, Column],
               accuracy: int) -> DataFrame:
    """Values at 0-based ranks, which may refer to __n, near the probabilities: one row per group with __n and a column a rank."""
    joined = null_safe_join(rows, _brackets(rows, by, probs, accuracy), by)
    k = range(len(probs))
    above_lo = reduce(lambda a, b: a + b, [(F.col("__v") >= F.col("__lo")[i]).cast("int") for i in k])
    above_hi = reduce(lambda a, b: a + b, [(F.col("__v") > F.col("__hi")[i]).cast("int") for i in k])
    # The segment grows with the value, and all of a segment lies inside a bracket or outside of all.
    tagged = joined.select(*by, "__n", (above_lo + above_hi).alias("__s"), F.when(above_lo > above_hi, F.col("__v")).alias("__v"))
    counted = tagged.groupBy(*by, "__s", "__v").agg(F.count(F.lit(1)).alias("__c"), F.first("__n").alias("__n"))
    w = Window.partitionBy(*by).orderBy("__s", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("__upto", F.sum("__c").over(w))
    bracketed = F.coalesce(F.col("__v"), F.raise_error(F.lit("a wanted rank lies outside its bracket")).cast("double"))
    picked = [F.max(F.when((r >= F.col("__upto") - F.col("__c")) & (r < F.col("__upto")), bracketed)).alias(name)
              for name, r in ranks.items()]
    return upto.groupBy(*by).agg(F.first("__n").alias("__n"), *picked)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str],
                    accuracy: int = ACCURACY) -> DataFrame:
    """One row per group with a column per probability; groups without values have none. ``accuracy`` sets the size of the
    summaries and of the brackets, not the result."""
    at = [(F.col("__n") - 1) * F.lit(float(p)) for p in probs]
    ranks = {f"__{end}{i}": f(a).cast("long") for i, a in enumerate(at) for end, f in (("a", F.floor), ("b", F.ceil))}
    found = _values_at(_values(df, by, value), by, probs, ranks, accuracy)
    out = []
    for i, (pos, name) in enumerate(zip(at, names)):
        a, b, part = F.col(f"__a{i}"), F.col(f"__b{i}"), pos - F.floor(pos)
        # Weighted form: exact at the ranks themselves, and between two equal infinite values.
        out.append(F.when(a == b, a).otherwise((1 - part) * a + part * b).alias(name))
    return found.select(*by, *out)


def order_statistic(df: DataFrame, value: str, rank: int, n: int | None = None, accuracy: int = ACCURACY) -> float:
    """The ``rank``-th smallest value (1-based). ``n``, the number of values, saves a scan where the caller knows it."""
    rows = _values(df, [], value)
    n = rows.count() if n is None else n
    if not 1 <= rank <= n:
        raise ValueError(f"rank {rank} outside 1..{n}")
    return _values_at(rows, [], [(rank - 1) / max(n - 1, 1)], {"x": F.lit(rank - 1)}, accuracy).first()["x"]
