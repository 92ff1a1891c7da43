"""Robust location and scatter by concentration steps on aggregates, and the outlier screen built on them.

A step of all starts is one job over the rows: products of the row are summed by start and bin of log squared distance
(``BINS`` bins an octave), so the sums of the h nearest rows are read off, a part of the bin that holds the h-th one being
taken by weight. Only these sums reach the driver, a few hundred rows a start whatever the number of rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplexspark.functions.scalars import decode_bits
from simplexspark.functions.simplex import Signs, add_all, balances, basis_matrix, sbp_basis
from simplexspark.operators.chisquare import chi2_quantile, gamma_p
from simplexspark.operators.composition import moments
from simplexspark.operators.quantiles import exact_quantiles
from simplexspark.operators.trimmed import BINS, add_by_bin, lts_fit, smallest  # noqa: F401
from simplexspark.sources.stages import cut


def _medians(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    long = df.unpivot([], [F.col(c) for c in cols], "variable", "value")
    found = {r["variable"]: r["m"] for r in exact_quantiles(long, ["variable"], "value", [0.5], ["m"]).collect()}
    return np.array([found[c] for c in cols], float)


def _robust_shapes(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Medians, scaled median deviations, and two bounded-influence correlation matrices over
    all rows: of hyperbolic tangents and of spatial signs (Hubert, Rousseeuw & Verdonck 2012).
    A column that is constant on more than half of the rows has deviation 0 and is left
    unscaled in the matrices."""
    med = _medians(df, cols)
    scale = 1.4826 * _medians(df.select(*[F.abs(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(cols, med)]), cols)
    scaled = {c: (F.col(c) - F.lit(float(m))) / F.lit(float(s or 1.0)) for c, m, s in zip(cols, med, scale)}
    length = F.sqrt(add_all([v * v for v in scaled.values()]))
    _, tanh = moments(df.select(*[F.tanh(v).alias(c) for c, v in scaled.items()]), cols)
    _, sign = moments(df.select(*[F.coalesce(F.try_divide(v, length), F.lit(0.0)).alias(c) for c, v in scaled.items()]), cols)
    shapes = []
    for shape in (tanh, sign):
        if (np.diag(shape) > 0).all():
            corr = shape / np.sqrt(np.outer(np.diag(shape), np.diag(shape)))
            if np.linalg.eigvalsh(corr)[0] > 1e-8:
                shapes.append(corr)
    return med, scale, shapes


def whitening(names: Sequence[str], scatter: np.ndarray) -> np.ndarray:
    """Matrix that maps deviations to vectors whose squared length is the squared distance."""
    values, vectors = np.linalg.eigh(scatter)
    if values[0] <= 1e-14 * max(values[-1], 1e-300):
        raise ValueError(f"scatter of {list(names)} is singular")
    return (vectors / np.sqrt(values)).T


def mahalanobis2(cols: Sequence[str], centre: np.ndarray, scatter: np.ndarray) -> Column:
    """Squared distance as Column arithmetic: the squared length of the whitened row."""
    white = whitening(cols, scatter)
    lines = [" + ".join(f"({float(w)!r}D) * ({c} - ({float(m)!r}D))" for w, c, m in zip(row, cols, centre)) for row in white]
    return F.expr(" + ".join(f"pow({x}, 2)" for x in lines))


@dataclass
class Start:
    """Centre and scatter a step starts from, in columns that are centred and scaled."""
    centre: np.ndarray
    scatter: np.ndarray


def concentrate(df: DataFrame, cols: Sequence[str], h: int, starts: Sequence[Start], centre: np.ndarray,
                scale: np.ndarray) -> list[Start]:
    """One concentration step of every start in one job: centre and scatter of its h nearest rows."""
    p, upper = len(cols), np.triu_indices(len(cols))
    maps = [(s.centre, whitening(cols, s.scatter)) for s in starts]
    names = ["n", *[f"s{i}" for i in range(p + len(upper[0]))]]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            u = (np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centre) / scale
            values = np.column_stack([np.ones(len(u)), u, u[:, upper[0]] * u[:, upper[1]]])
            for k, (m, white) in enumerate(maps):
                d2 = (((u - m) @ white.T) ** 2).sum(axis=1)
                with np.errstate(divide="ignore"):
                    place = np.clip(np.floor(np.log2(d2) * BINS), -1001, 1000).astype(int)
                add_by_bin(total, k, place, values)
        columns = np.array(list(total.values())).reshape(len(total), len(names)).T
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([b for _, b in total], pa.int32()), *[pa.array(c) for c in columns]],
                                         names=["start", "bin", *names])

    rows = df.select(*[F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(cols)])
    sums = rows.mapInArrow(add_up, "start int, bin int, " + ", ".join(f"{n} double" for n in names))
    table = sums.groupBy("start", "bin").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = []
    for _, part in sorted(table.groupby("start")):
        found = smallest(part.drop(columns="start").to_numpy(float), h)
        mean, second = found[1:1 + p] / found[0], np.zeros((p, p))
        second[upper] = found[1 + p:] / found[0]
        second = np.triu(second) + np.triu(second, 1).T
        out.append(Start(mean, second - np.outer(mean, mean)))
    return out


def robust_location_scatter(df: DataFrame, cols: Sequence[str], max_steps: int = 100,
                            tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Minimum covariance determinant with h = (n+p+1)/2, from three deterministic starts
    (Hubert, Rousseeuw & Verdonck 2012) that take their first two steps side by side, made
    consistent at the normal and reweighted once at the 97.5 % point."""
    cols, p = list(cols), len(cols)
    df = df.select(*cols).dropna()
    n = df.count()
    h = (n + p + 1) // 2
    if n <= 2 * p:
        raise ValueError(f"{n} rows are too few for {p} columns")
    centre, scale, shapes = _robust_shapes(df, cols)
    for c, v in zip(cols, scale):
        if not v:
            raise ValueError(f"column {c} is constant on more than half of the rows")
    tried = [Start(np.zeros(p), shape) for shape in (np.eye(p), *shapes)]
    for _ in range(2):
        tried = concentrate(df, cols, h, tried, centre, scale)
    best = min(tried, key=lambda s: np.linalg.det(s.scatter))
    for _ in range(max_steps):
        following, = concentrate(df, cols, h, [best], centre, scale)
        gain = np.linalg.det(best.scatter) - np.linalg.det(following.scatter)
        if gain <= tol * np.linalg.det(best.scatter):
            break
        best = following
    else:
        warnings.warn(f"location and scatter had not settled after {max_steps} steps", stacklevel=2)
    m, s = centre + scale * best.centre, best.scatter * np.outer(scale, scale) * _consistency(h / n, p)
    cutoff = chi2_quantile(0.975, p)
    m, s = moments(df.filter(mahalanobis2(cols, m, s) <= cutoff), cols, sample=True)
    return m, s * _consistency(0.975, p)


def _consistency(share: float, p: int) -> float:
    q = chi2_quantile(share, p)
    return share / gamma_p(p / 2 + 1, q / 2)


@dataclass
class OutlierModel:
    parts: list[str]
    signs: Signs
    centre: np.ndarray
    scatter: np.ndarray
    cutoff: float
    cutoff_without: float


def fit_outliers(df: DataFrame, parts: Sequence[str], signs: Signs, alpha: float = 0.05,
                 corrected: bool = True) -> OutlierModel:
    """Robust normal model of the balances. With ``corrected`` the test level holds for the
    largest distance of the whole table: 1-(1-alpha)^(1/n) per row."""
    names = list(signs)
    z = cut(df.select(*[c.alias(k) for k, c in balances(parts, signs).items()]).dropna(), "outlier-coords")
    centre, scatter = robust_location_scatter(z, names)
    n = z.count()
    level = -math.expm1(math.log1p(-alpha) / n) if corrected else alpha
    return OutlierModel(list(parts), signs, centre, scatter, chi2_quantile(1 - level, len(names)),
                        chi2_quantile(1 - level, len(names) - 1))


def _without(model: OutlierModel, part: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Centre and scatter of log coordinates of the composition without one part: the image
    of the fitted ones under the linear map from all balances to the smaller basis."""
    from simplexspark.functions.simplex import pivot_signs

    rest = [p for p in model.parts if p != part]
    full = basis_matrix(sbp_basis(model.signs), model.parts)
    small = basis_matrix(sbp_basis(pivot_signs(rest)), model.parts)
    link = small.T @ full
    return rest, link @ model.centre, link @ model.scatter @ link.T


def flag_outliers(df: DataFrame, model: OutlierModel) -> DataFrame:
    """Add d2, outlier (Outlier / No outlier), outlier_bin, outlier_code and outlier_cause.
    Bit j of the code is 1 when the row without part j is no longer an outlier; all zeros
    means no single part explains it."""
    from simplexspark.functions.simplex import pivot_signs

    names = list(model.signs)
    z = {f"__z_{k}": c for k, c in balances(model.parts, model.signs).items()}
    views, tests = {}, []
    for j, p in enumerate(model.parts):
        rest, centre, scatter = _without(model, p)
        cols = [f"__w{j}_{k}" for k in pivot_signs(rest)]
        views.update(dict(zip(cols, balances(rest, pivot_signs(rest)).values())))
        tests.append(mahalanobis2(cols, centre, scatter) <= F.lit(model.cutoff_without))
    d2 = mahalanobis2([f"__z_{k}" for k in names], model.centre, model.scatter)
    bits = F.concat(*[F.when(t, "1").otherwise("0") for t in tests])
    out = df.withColumns({**z, **views}).withColumn("d2", d2)
    is_out = F.col("d2") > F.lit(model.cutoff)
    out = (out.withColumn("outlier_code", F.when(is_out, bits).when(F.col("d2").isNotNull(), F.lit("ok")))
           .drop(*z, *views))
    return attach_cause(out, model.parts)


def attach_cause(df: DataFrame, parts: Sequence[str], code: str = "outlier_code") -> DataFrame:
    """Flag, 0/1 flag and cause from the code column."""
    ok = F.col(code) == "ok"
    return df.withColumns({
        "outlier": F.when(ok, "No outlier").when(F.col(code).isNotNull(), "Outlier"),
        "outlier_bin": F.when(ok, 0).when(F.col(code).isNotNull(), 1),
        "outlier_cause": decode_bits(code, parts)})


def drop_weak_outliers(df: DataFrame, threshold: int = 3) -> DataFrame:
    """Remove outliers with at most ``threshold`` originally observed parts."""
    weak = (F.col("n_observed") <= threshold) & (F.col("outlier") == "Outlier")
    return df.filter(~F.coalesce(weak, F.lit(False)))


def screen_tables(flags: DataFrame, group: Sequence[str], threshold: int = 3) -> DataFrame:
    """Tables of a screened panel in long form: (report, *group, outlier, detail, n, value).

    ``shares``: rows by group and flag, value their share of the group. ``observed``: outliers by group and ``n_observed``
    (detail). ``causes``: outliers by group and cause (detail). ``kept``: rows by group and flag once outliers with at most
    ``threshold`` observed parts are gone. ``rates``: rows by group, value the percentage of outliers. Rows whose flag is null (a
    part is missing) take part in none. One shuffle of one row a task and combination; the tables come from those counts.
    """
    cells = [*group, "outlier", "n_observed", "outlier_cause"]
    counts = cut(flags.where(F.col("outlier").isNotNull()).groupBy(*cells).agg(F.count(F.lit(1)).alias("n")), "screen-counts")
    out, is_out = F.col("outlier"), F.col("outlier") == "Outlier"
    nothing, no_value = F.lit(None).cast("string"), F.lit(None).cast("double")

    def report(name: str, rows: DataFrame, by: Sequence[str], detail: Column, flag: Column, value: Column) -> DataFrame:
        sums = rows.groupBy(*group, *by).agg(F.sum("n").alias("n"), F.sum(F.when(is_out, F.col("n")).otherwise(0)).alias("__out"))
        return sums.select(F.lit(name).alias("report"), *group, flag.alias("outlier"), detail.cast("string").alias("detail"), "n", value.alias("value"))

    of_group = F.col("n") / F.sum("n").over(Window.partitionBy(*group))
    return (report("shares", counts, ["outlier"], nothing, out, of_group)
            .unionByName(report("observed", counts.where(is_out), ["n_observed"], F.col("n_observed"), F.lit("Outlier"), no_value))
            .unionByName(report("causes", counts.where(is_out), ["outlier_cause"], F.col("outlier_cause"), F.lit("Outlier"), no_value))
            .unionByName(report("kept", drop_weak_outliers(counts, threshold), ["outlier"], nothing, out, no_value))
            .unionByName(report("rates", counts, [], nothing, nothing, 100 * F.col("__out") / F.col("n"))))
