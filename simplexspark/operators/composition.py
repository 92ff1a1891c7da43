"""Whole-table log-ratio statistics: variation matrix, clr covariance, principal components."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexspark.functions.simplex import add_all, clr, log_part


def variation_matrix(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """var(ln(p_i/p_j)) for every ordered pair of different parts, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(parts) for b in parts[i + 1:]]
    row = df.agg(*[F.var_samp(log_part(a) - log_part(b)).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(x).alias("part_i"), F.lit(y).alias("part_j"), F.col(f"`{a}|{b}`").alias("value"))
             for a, b in pairs for x, y in ((a, b), (b, a))]
    return row.select(F.inline(F.array(*cells)))


def covariance(df: DataFrame, cols: Sequence[str], sample: bool = False) -> DataFrame:
    """Means and covariances of columns in long form (i, j, mean_i, mean_j, cov), divisor n
    unless ``sample``; one aggregate of a few dozen sums."""
    f = F.covar_samp if sample else F.covar_pop
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.dropna(subset=list(cols)).agg(*[F.avg(c).alias(f"m|{c}") for c in cols],
                                           *[f(a, b).alias(f"c|{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"`m|{a}`").alias("mean_i"),
                      F.col(f"`m|{b}`").alias("mean_j"), F.col(f"`c|{a}|{b}`").alias("cov")) for a, b in pairs]
    return row.select(F.inline(F.array(*cells)))


def moments(df: DataFrame, cols: Sequence[str], sample: bool = False, also: str | None = None):
    """Mean vector and covariance matrix on the driver, D means and D(D+1)/2 numbers; with
    ``also`` the sum of that column as a third value from the same pass."""
    f = F.covar_samp if sample else F.covar_pop
    upper = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.dropna(subset=list(cols)).agg(*[F.avg(c) for c in cols], *[f(cols[i], cols[j]) for i, j in upper],
                                           F.sum(also) if also else F.lit(0.0)).first()
    if row[0] is None or row[len(cols)] is None:
        raise ValueError(f"no complete rows for {list(cols)}")
    mean, cov = np.array(row[:len(cols)], dtype=float), np.zeros((len(cols), len(cols)))
    for (i, j), value in zip(upper, row[len(cols):-1]):
        cov[i, j] = cov[j, i] = value
    return (mean, cov, row[-1]) if also else (mean, cov)


def centred_moments(df: DataFrame, cols: Sequence[str], centre: np.ndarray, scale: np.ndarray, also: str | None = None):
    """As :func:`moments` with divisor n, from plain sums of products around a given centre and
    scale: much lighter to compile than covariance aggregates, which matters in a loop of small
    fits, and safe because the values are already centred. ``df`` has no nulls."""
    u = [f"({c} - ({float(m)!r}D)) / {float(s)!r}D AS u{i}" for i, (c, m, s) in enumerate(zip(cols, centre, scale))]
    k = range(len(cols))
    upper = [(i, j) for i in k for j in k if i <= j]
    row = (df.selectExpr(*u, f"{also or '0D'} AS extra")
           .selectExpr("count(1)", "sum(extra)", *[f"sum(u{i})" for i in k], *[f"sum(u{i} * u{j})" for i, j in upper]).first())
    n = row[0]
    if not n:
        raise ValueError(f"no rows for {list(cols)}")
    mean = np.array(row[2:2 + len(cols)], float) / n
    second = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(upper, row[2 + len(cols):]):
        second[i, j] = second[j, i] = v / n
    cov = (second - np.outer(mean, mean)) * np.outer(scale, scale)
    out = centre + scale * mean
    return (out, cov, row[1]) if also else (out, cov)


@dataclass
class Pca:
    parts: list[str]
    mean: np.ndarray
    variances: np.ndarray
    loadings: np.ndarray  # one column per component

    def summary(self, df: DataFrame) -> DataFrame:
        """(component, sd, pct_variance)."""
        whole = float(self.variances.sum())
        rows = [(i + 1, math.sqrt(v), 100.0 * v / whole) for i, v in enumerate(map(float, self.variances))]
        return df.sparkSession.createDataFrame(rows, "component int, sd double, pct_variance double")

    def loading_table(self, df: DataFrame) -> DataFrame:
        rows = [(p, i + 1, float(self.loadings[k, i])) for k, p in enumerate(self.parts)
                for i in range(len(self.variances))]
        return df.sparkSession.createDataFrame(rows, "part string, component int, loading double")

    def scores(self, df: DataFrame, keep: Sequence[str] = (), n: int | None = None) -> DataFrame:
        """Component scores of each row: centred clr times loadings, in one projection."""
        logs = clr(self.parts)
        cols = [add_all([(logs[p] - F.lit(float(self.mean[k]))) * F.lit(float(self.loadings[k, i]))
                         for k, p in enumerate(self.parts)]).alias(f"pc{i + 1}")
                for i in range(n or len(self.variances))]
        return df.select(*keep, *cols)


def clr_pca(df: DataFrame, parts: Sequence[str]) -> Pca:
    """Principal components of clr rows, covariance with divisor n. The largest loading of
    each component is made positive."""
    logs = clr(parts)
    mean, cov = moments(df.select(*[logs[p].alias(p) for p in parts]), parts)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0.0, None), vectors[:, order]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(parts))]
    return Pca(list(parts), mean, values, vectors * np.where(lead < 0, -1.0, 1.0))


def biplot(df: DataFrame, parts: Sequence[str], group: str | None = None) -> DataFrame:
    """First two components as one table: a row per case (tagged by group) and per part."""
    pca = clr_pca(df, parts)
    tag = F.col(group).cast("string") if group else F.lit(None).cast("string")
    cases = pca.scores(df.withColumn("label", tag), ["label"], 2).withColumn("kind", F.lit("case"))
    arrows = [(p, float(pca.loadings[k, 0]), float(pca.loadings[k, 1]), "part") for k, p in enumerate(parts)]
    return cases.unionByName(df.sparkSession.createDataFrame(arrows, "label string, pc1 double, pc2 double, kind string"))
