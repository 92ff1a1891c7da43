"""Least trimmed squares for several regressions at once, in nested form.

1. All rows are dealt to random blocks. In each block, inside one task, many small random subsets start a fit; two
   concentration steps on the block's own rows (vectorised over the starts) leave the best few, which are concentrated until
   they settle. The block's best fit is its vote.
2. The votes are pooled by the median of each coefficient: spoilt blocks cannot move it while they are the smaller part.
3. Concentration steps over all rows follow. One job a step serves all regressions: rows are counted and their products
   summed by regression and by bin of log squared residual (``BINS`` bins an octave), so the sums of the h smallest squared
   residuals are read off, a part of the bin that holds the h-th one being taken by weight.
4. Residuals beyond 2.5 robust scales are dropped, in one more job.

A step sends a few hundred rows of sums a regression to the driver, whatever the number of rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexspark.operators.chisquare import chi2_quantile, gamma_p
from simplexspark.sources.stages import cut

BLOCK, STARTS, BEST, BINS = 2000, 300, 10, 16
#: Stands for the bin in rows that say how far the last fill moved.
MOVED = 1 << 20


@dataclass
class View:
    """Rows of one regression: where it holds, and its response followed by its regressors."""
    where: Column
    columns: Sequence[Column]


@dataclass
class Scale:
    """Number of rows, means and deviations of a regression's columns."""
    n: int
    centre: np.ndarray
    spread: np.ndarray


def solve(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Intercept and slopes of the first column on the others."""
    beta = np.linalg.lstsq(cov[1:, 1:], cov[1:, 0], rcond=None)[0]
    return np.concatenate([[mean[0] - mean[1:] @ beta], beta])


class Views:
    """The regressions' columns side by side, so that one scan serves all of them. ``rows`` keeps the same plan from step to step;
    what changes goes to the tasks with the function that sums."""

    def __init__(self, df: DataFrame, views: Mapping[str, View]) -> None:
        self.names, self.p = list(views), len(next(iter(views.values())).columns)
        columns = []
        for j, v in enumerate(views.values()):
            z = [c.cast("double").alias(f"z{j}_{i}") for i, c in enumerate(v.columns)]
            columns += [F.coalesce(v.where, F.lit(False)).alias(f"in{j}"), *z]
        self.rows = df.select(*columns)

    def reader(self) -> Parts:
        """What splits a task's batches of ``rows``."""
        return Parts(self.p, len(self.names))

    def long(self) -> DataFrame:
        z = range(self.p)
        structs = [F.struct(F.lit(n).alias("fit"), F.col(f"in{j}").alias("in"), *[F.col(f"z{j}_{i}").alias(f"z{i}") for i in z]) for j, n in enumerate(self.names)]
        return self.rows.select(F.inline(F.array(*structs))).where("in").drop("in").dropna()


@dataclass
class Parts:
    """Splits a batch of :class:`Views` rows: (place, rows) of each regression, without rows that have nulls."""
    p: int
    fits: int

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for j in range(self.fits):
            held, *z = (batch.column(j * (self.p + 1) + i).to_numpy(zero_copy_only=False) for i in range(self.p + 1))
            rows = np.column_stack(z).astype(float)[held.astype(bool)]
            yield j, rows[np.isfinite(rows).all(axis=1)]


def scales(views: Views) -> dict[str, Scale]:
    z = [f"z{i}" for i in range(views.p)]
    found = views.long().groupBy("fit").agg(F.count("*").alias("n"), *[F.avg(c) for c in z], *[F.stddev_pop(c) for c in z]).collect()
    out = {r[0]: Scale(r[1], np.array(r[2:2 + views.p], float), np.maximum(np.array(r[2 + views.p:], float), 1e-150)) for r in found}
    for name in views.names:
        n = out[name].n if name in out else 0
        if n <= views.p:
            raise ValueError(f"{n} rows cannot fit {views.p} coefficients of {name}")
    return out


def coverage(n: int, p: int, trim: float) -> int:
    return min(n, max((n + p + 1) // 2, int((1 - trim) * n)))


def concentrated(x: np.ndarray, y: np.ndarray, betas: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """One step of every start: the fits to its h smallest squared residuals, and the objectives before."""
    r2 = (y[None] - betas @ x.T) ** 2
    level = np.partition(r2, h - 1, axis=1)[:, h - 1:h]
    w = r2 <= level
    gram = np.einsum("sn,ni,nj->sij", w, x, x, optimize=True)
    right = (w * y) @ x
    ridge = 1e-12 * np.trace(gram, axis1=1, axis2=2)[:, None, None] * np.eye(x.shape[1]) + 1e-300
    return np.linalg.solve(gram + ridge, right[..., None])[..., 0], np.where(w, r2, 0.0).sum(axis=1)


def block_vote(z: np.ndarray, trim: float) -> np.ndarray:
    """Trimmed fit of a block, columns scaled: response first."""
    n, p = z.shape
    x, y, rng = np.column_stack([np.ones(n), z[:, 1:]]), z[:, 0], np.random.default_rng(n)
    h = coverage(n, p, trim)
    picks = rng.integers(0, n, (STARTS, p))
    betas = np.linalg.solve(x[picks] + 1e-9 * np.eye(p), y[picks][..., None])[..., 0]
    for _ in range(2):
        betas, _ = concentrated(x, y, betas, h)
    _, objective = concentrated(x, y, betas, h)
    betas, last = betas[np.argsort(objective)[:BEST]], None
    for _ in range(50):
        following, objective = concentrated(x, y, betas, h)
        if last is not None and (last - objective <= 1e-6 * last).all():
            break
        betas, last = following, objective
    return betas[np.argmin(concentrated(x, y, betas, h)[1])]


def nested_starts(views: Views, base: Mapping[str, Scale], trim: float) -> dict[str, np.ndarray]:
    """Pooled votes of the blocks."""
    p = views.p
    z, size = [f"z{i}" for i in range(p)], max(BLOCK, 20 * p)
    blocks = max(1, round(max(s.n for s in base.values()) / size))
    dealt = views.long().withColumn("block", F.floor(F.rand(20) * blocks))

    def vote(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) <= 2 * p and blocks > 1:
            return pd.DataFrame(columns=["fit", *z])
        name = rows["fit"].iloc[0]
        beta = block_vote((rows[z].to_numpy() - base[name].centre) / base[name].spread, trim)
        return pd.DataFrame([[name, *beta]], columns=["fit", *z])

    votes = dealt.groupBy("fit", "block").applyInPandas(vote, "fit string, " + ", ".join(f"{c} double" for c in z))
    out = {}
    for row in votes.groupBy("fit").agg(*[F.percentile(c, 0.5).alias(c) for c in z]).collect():
        s, scaled = base[row["fit"]], np.array(row[1:], float)
        slopes = scaled[1:] * s.spread[0] / s.spread[1:]
        out[row["fit"]] = np.concatenate([[s.centre[0] + scaled[0] * s.spread[0] - slopes @ s.centre[1:]], slopes])
    return out


def add_by_bin(total: dict[tuple[int, int], np.ndarray], fit: int, place: np.ndarray, values: np.ndarray) -> None:
    """Add rows of values to the sums of their fit and bin."""
    order = np.argsort(place, kind="stable")
    bins, first = np.unique(place[order], return_index=True)
    for b, sums in zip(bins.tolist(), np.add.reduceat(values[order], first, axis=0)):
        total[fit, b] = total[fit, b] + sums if (fit, b) in total else sums


def summed(views: Views, base: Mapping[str, Scale], betas: Mapping[str, np.ndarray], limits: Mapping[str, float] | None = None) -> pd.DataFrame:
    """Counts, squared residuals and sums of scaled products by regression and bin of log squared residual; with ``limits``,
    of the rows up to them in one bin. A task adds up its rows and hands on a row a bin."""
    p, upper = views.p, np.triu_indices(views.p)
    names = ["n", "r2", *[f"s{i}" for i in range(p + len(upper[0]))]]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for j, rows in views_parts(batch):
                name = views_names[j]
                beta, scale = betas[name], base[name]
                r2 = (rows[:, 0] - beta[0] - rows[:, 1:] @ beta[1:]) ** 2
                if limits is not None:
                    rows, r2 = rows[r2 <= limits[name]], r2[r2 <= limits[name]]
                if not len(rows):
                    continue
                u = (rows - scale.centre) / scale.spread
                values = np.column_stack([np.ones(len(rows)), r2, u, u[:, upper[0]] * u[:, upper[1]]])
                with np.errstate(divide="ignore"):
                    place = np.clip(np.floor(np.log2(r2 / scale.spread[0] ** 2) * BINS), -1001, 1000).astype(int) if limits is None else np.zeros(len(rows), int)
                add_by_bin(total, j, place, values)
        for j, (n, squares) in enumerate(getattr(views_parts, "moved", ())):
            total[j, MOVED] = np.array([n, squares, *[0.0] * (len(names) - 2)])
        columns = np.array(list(total.values())).reshape(len(total), len(names)).T
        yield pa.RecordBatch.from_arrays([pa.array([views_names[j] for j, _ in total], pa.string()), pa.array([b for _, b in total], pa.int32()), *[pa.array(c) for c in columns]],
                                         names=["fit", "bin", *names])

    views_parts, views_names = views.reader(), list(views.names)
    sums = views.rows.mapInArrow(add_up, "fit string, bin int, " + ", ".join(f"{n} double" for n in names))
    table = sums.groupBy("fit", "bin").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    views.moved = {r.fit: (r.n, r.r2) for r in table[table["bin"] == MOVED].itertuples()}
    return table[table["bin"] != MOVED]


def fitted(sums: np.ndarray, base: Scale) -> np.ndarray:
    """Regression from count, squared residuals, sums and products of scaled columns."""
    p = len(base.centre)
    mean = sums[2:2 + p] / sums[0]
    second = np.zeros((p, p))
    second[np.triu_indices(p)] = sums[2 + p:] / sums[0]
    second = np.triu(second) + np.triu(second, 1).T
    return solve(base.centre + base.spread * mean, (second - np.outer(mean, mean)) * np.outer(base.spread, base.spread))


def smallest(rows: np.ndarray, h: int) -> np.ndarray:
    """Sums over the h smallest squared residuals, from rows (bin, sums) of all bins."""
    rows = rows[np.argsort(rows[:, 0])][:, 1:]
    upto = np.cumsum(rows[:, 0])
    last = int(np.searchsorted(upto, h))
    before = upto[last] - rows[last, 0]
    return rows[:last].sum(axis=0) + rows[last] * ((h - before) / rows[last, 0])


def trimmed_fits(views: Views, trim: float = 0.5, starts: Mapping[str, np.ndarray] | None = None, base: Mapping[str, Scale] | None = None,
                 max_steps: int = 100, tol: float = 1e-4, settle: bool = True, first: pd.DataFrame | None = None) -> dict[str, np.ndarray]:
    """Intercept and slopes of each regression: least trimmed squares over its rows without nulls, reweighted once. All views
    have the same number of columns. Without ``starts`` the nested starts are taken; ``base`` may be given where it is known. Warns if
    ``max_steps`` are too few, unless the caller comes back with the fits (``settle=False``). ``first`` are the sums at the starts, if they
    are at hand. A regression with fewer rows than coefficients raises ValueError."""
    base = base or scales(views)
    betas = dict(starts) if starts else nested_starts(views, base, trim)
    h = {name: coverage(base[name].n, len(base[name].centre), trim) for name in views.names}
    objective: dict[str, float] = {}
    for _ in range(max_steps):
        table, first = summed(views, base, betas) if first is None else first, None
        settled = True
        for name, rows in table.groupby("fit"):
            sums = smallest(rows.drop(columns="fit").to_numpy(float), h[name])
            if name not in objective or objective[name] - sums[1] > tol * max(objective[name], 1e-300):
                betas[name], settled = fitted(sums, base[name]), False
            objective[name] = sums[1]
        if settled:
            break
    else:
        if settle:
            warnings.warn(f"trimmed fits of {sorted(views.names)} had not settled after {max_steps} steps", stacklevel=2)
    limits = {}
    for name in views.names:
        # Consistency factor of the h smallest squares under normal errors.
        n, q = base[name].n, math.inf
        q = chi2_quantile(h[name] / n, 1) if h[name] < n else q
        factor = h[name] / n / gamma_p(1.5, q / 2) if h[name] < n else 1.0
        limits[name] = 2.5 ** 2 * factor * objective[name] / h[name] or math.inf
    table = summed(views, base, betas, limits)
    return {name: fitted(rows.drop(columns=["fit", "bin"]).to_numpy(float)[0], base[name]) for name, rows in table.groupby("fit")}


def lts_fit(df: DataFrame, y: str, xs: Sequence[str], trim: float = 0.5, start: np.ndarray | None = None, max_steps: int = 100, tol: float = 1e-4) -> np.ndarray:
    """Least trimmed squares of ``y`` on ``xs``: intercept and slopes."""
    rows = cut(df.select(y, *xs).dropna(), "trimmed")
    views = Views(rows, {y: View(F.lit(True), [F.col(c) for c in (y, *xs)])})
    return trimmed_fits(views, trim, None if start is None else {y: start}, None, max_steps, tol)[y]
