"""Projection, reshaping and monthly-panel operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simplexspark.functions.scalars import count_observed


def relocate(df: DataFrame, cols: Sequence[str], after: str | None = None) -> DataFrame:
    """Move columns behind another one, or to the front."""
    rest = [c for c in df.columns if c not in set(cols)]
    at = rest.index(after) + 1 if after else 0
    return df.select(*rest[:at], *cols, *rest[at:])


def columns_of_type(df: DataFrame, kind: type[T.DataType] = T.NumericType) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def min_observed(df: DataFrame, parts: Sequence[str], m: int = 2) -> DataFrame:
    """Keep rows with at least ``m`` observed parts."""
    return df.filter(count_observed(parts) >= m)


def monthly_mean(df: DataFrame, keys: Sequence[str], value: str, attributes: Sequence[str], order: str) -> DataFrame:
    """Grouped mean carrying the attributes of the earliest row of each group. The
    attributes come from one ``min_by`` so they stay together whatever the partitioning;
    equal ``order`` values fall back to the smallest attribute values."""
    first = F.min_by(F.struct(*attributes), F.struct(order, *attributes))
    return (df.groupBy(*keys).agg(F.avg(value).alias(value), first.alias("__first"))
            .select(*keys, value, *[F.col("__first")[a].alias(a) for a in attributes]))


def pivot_parts(df: DataFrame, ids: Sequence[str], name: str, value: str, levels: Sequence[str]) -> DataFrame:
    """Long to wide with an explicit level list: one shuffle, no discovery job. Each
    (ids, level) holds at most one row, which :func:`duplicate_keys` can prove."""
    cells = [F.max(F.when(F.col(name) == lv, F.col(value))).alias(lv) for lv in levels]
    return df.groupBy(*ids).agg(*cells)


def monthly_wide(df: DataFrame, ids: Sequence[str], name: str, value: str, levels: Sequence[str]) -> DataFrame:
    """Monthly mean and pivot fused: one aggregate with a conditional mean per part, so the
    long monthly table is never shuffled a second time."""
    cells = [F.avg(F.when(F.col(name) == lv, F.col(value))).alias(lv) for lv in levels]
    return df.groupBy(*ids).agg(*cells)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable",
            value: str = "value") -> DataFrame:
    """Wide to long, keeping null cells."""
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in values], name, value)


def split_statistic(c: Column, sep: str = "__") -> tuple[Column, Column]:
    """Split ``variable__statistic`` names into their two halves."""
    bits = F.split(c, sep)
    return F.get(bits, F.lit(0)), F.get(bits, F.lit(1))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``, the same one on every run."""
    rest = [c for c in df.columns if c not in set(keys)]
    pick = F.min_by(F.struct(*rest), F.struct(*order, *rest))
    return (df.groupBy(*keys).agg(pick.alias("__row"))
            .select(*[F.col(c) if c in set(keys) else F.col("__row")[c].alias(c) for c in df.columns]))


def mean_duplicates(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Collapse repeated keys to the mean of each value, skipping nulls."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def monthly_wide_to_long(df: DataFrame, ids: Sequence[str], prefix: str, months: Mapping[str, int],
                         value: str) -> DataFrame:
    """Twelve month-named columns to (ids, month, value); other columns, such as the annual
    figure, are left out. Equal to unpivoting, stripping the prefix and mapping the name."""
    named = {c[len(prefix):].strip(): c for c in df.columns if c.startswith(prefix)}
    return (df.withColumnsRenamed({c: m for m, c in named.items() if m in months})
            .unpivot([F.col(c) for c in ids], [F.col(m) for m in months if m in named], "__name", value)
            .select(*ids, F.create_map(*[F.lit(v) for kv in months.items() for v in kv])[F.col("__name")]
                    .alias("month"), value))


def with_months(df: DataFrame, years: Sequence[int], months: Sequence[int] = range(1, 13)) -> DataFrame:
    """Every row repeated for each year and month: a narrow explode of a literal list, so no
    join and no shuffle."""
    frames = F.array(*[F.struct(F.lit(y).alias("year"), F.lit(m).alias("month")) for y in years for m in months])
    return df.withColumn("__ym", F.explode(frames)).select(*df.columns, "__ym.year", "__ym.month")
