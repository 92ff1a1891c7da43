"""Space-time exposure surface: fixed effects, place intercepts, a Matern field with monthly
AR(1) memory, and predictions with 95 % bands.

Estimation works on sufficient statistics. One pass over the rows gives sums per place for
all responses at once; every later step reads that table or a short table of distance bins.
Prediction is local kriging on a bounded set of neighbours per target.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexspark.functions.scalars import clamp, month_index
from simplexspark.functions.simplex import add_all
from simplexspark.operators.joins import by_shuffle
from simplexspark.operators.knn import knn_join
from simplexspark.operators.ranking import split_exact
from simplexspark.operators.reshape import unpivot
from simplexspark.operators.stats import score
from simplexspark.sources.stages import cut

Z95 = 1.959964
#: Targets whose covariances a task holds at once.
KRIGED = 500


def model_frame(stations: DataFrame, grid: DataFrame, responses: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Observed and to-predict rows in one frame: ``tag`` est or pred, null responses on
    the pred rows."""
    est = stations.select(F.lit("est").alias("tag"), *responses, *columns)
    pred = grid.select(F.lit("pred").alias("tag"), *[F.lit(None).cast("double").alias(y) for y in responses], *columns)
    return est.unionByName(pred)


# --- fixed effects and place intercepts -------------------------------------------------


@dataclass
class MixedFit:
    """Coefficients on centred and scaled regressors, their covariance, and the variance
    components of the place intercepts and the remainder."""

    response: str
    xs: list[str]
    centre: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    cov: np.ndarray
    sigma_e2: float
    sigma_u2: float
    n: int

    def _z(self) -> list[Column]:
        return [F.lit(1.0)] + [(F.col(x) - F.lit(float(m))) / F.lit(float(s))
                               for x, m, s in zip(self.xs, self.centre, self.scale)]

    def fixed_mean(self) -> Column:
        return add_all([F.lit(float(b)) * z for b, z in zip(self.beta, self._z())])

    def fixed_var(self) -> Column:
        z = self._z()
        return add_all([F.lit(float(self.cov[i, j] * (1 if i == j else 2))) * z[i] * z[j]
                        for i in range(len(z)) for j in range(i, len(z))])

    def table(self, spark: SparkSession) -> DataFrame:
        """(term, mean, sd, q025, q975) on the regressors' own scale."""
        p = len(self.xs)
        back = np.eye(p + 1)
        back[1:, 1:] = np.diag(1 / self.scale)
        back[0, 1:] = -self.centre / self.scale
        mean, sd = back @ self.beta, np.sqrt(np.diag(back @ self.cov @ back.T))
        rows = [(t, float(m), float(s), float(m - Z95 * s), float(m + Z95 * s))
                for t, m, s in zip(["intercept", *self.xs], mean, sd)]
        return spark.createDataFrame(rows, "term string, mean double, sd double, q025 double, q975 double")


def gram_sums(df: DataFrame, responses: Sequence[str], xs: Sequence[str], group: str | Sequence[str], centre: Sequence[float],
              scale: Sequence[float]) -> DataFrame:
    """Per group (one column or several) and response: n and all sums and cross sums of the scaled regressors and the
    response, over rows where both are known. One shuffle of one row per group and task."""
    z = [F.lit(1.0)] + [(F.col(x) - F.lit(float(m))) / F.lit(float(s)) for x, m, s in zip(xs, centre, scale)]
    p, sums = len(z), []
    for r, y in enumerate(responses):
        def add(c: Column, name: str) -> None:
            sums.append(F.sum(F.when(F.col(y).isNotNull(), c)).alias(f"{name}_{r}"))
        for i in range(p):
            for j in range(i, p):
                add(z[i] * z[j], f"c{i}_{j}")
            add(z[i] * F.col(y), f"y{i}")
        add(F.col(y) * F.col(y), "yy")
    keys = [group] if isinstance(group, str) else list(group)
    return df.dropna(subset=[*xs, *keys]).groupBy(*keys).agg(*sums)


def fit_many(df: DataFrame, responses: Sequence[str], xs: Sequence[str], group: str, max_rounds: int = 100,
             tol: float = 1e-5, inflation: dict[str, float] | None = None) -> tuple[dict[str, MixedFit], DataFrame]:
    """Fixed effects by generalised least squares with a random intercept per group, for all
    responses in the same passes. Variance components by moments (between and within groups);
    each round refreshes the components and then the coefficients, until the components settle to
    ``tol``; one job over the group table a round. Also returns the group
    effects (group, and per response u_<y>, uvar_<y>): means shrunk by n*su2/(n*su2+se2).
    ``inflation`` multiplies the variance of a group mean when rows of a group are correlated,
    as the months of a station are; without it that correlation is taken for group effects."""
    xs, responses, p = list(xs), list(responses), len(xs) + 1
    row = df.agg(*[f(x) for x in xs for f in (F.avg, F.stddev_pop)]).first() if xs else []
    centre, scale = np.array(row[0::2], float), np.array(row[1::2], float)
    for x, s in zip(xs, scale):
        if not s > 0:
            raise ValueError(f"regressor {x} is constant or empty")
    g = cut(gram_sums(df, responses, xs, group, centre, scale), "group-sums")
    ij = [(i, j) for i in range(p) for j in range(i, p)]

    def square(values: Sequence[float]) -> np.ndarray:
        m = np.zeros((p, p))
        for (i, j), v in zip(ij, values):
            m[i, j] = m[j, i] = v
        return m

    def totals(exprs: list[Column], width: int) -> list[np.ndarray]:
        got = np.array([np.nan if v is None else v for v in g.agg(*exprs).first()], float)
        return [got[k * width:(k + 1) * width] for k in range(len(responses))]

    width = len(ij) + p + 1
    sums = totals([F.sum(f"{n}_{r}") for r in range(len(responses))
                   for n in [*[f"c{i}_{j}" for i, j in ij], *[f"y{i}" for i in range(p)], "yy"]], width)
    c = [square(s[:len(ij)]) for s in sums]
    cy = [s[len(ij):-1] for s in sums]
    yy = [s[-1] for s in sums]
    n = [m[0, 0] for m in c]
    beta = [np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(c, cy)]
    su2, se2, cov = [0.0] * len(n), [0.0] * len(n), [np.eye(p)] * len(n)

    def rest(r: int) -> Column:
        """Sum of residuals of a group."""
        return F.col(f"y0_{r}") - add_all([F.lit(float(b)) * F.col(f"c0_{i}_{r}") for i, b in enumerate(beta[r])])

    # Sums over groups of products of (y, 1, x...) totals by size: the between sum of squares is a form in these.
    def total(i: int, r: int) -> Column:
        return F.col(f"c0_{i - 1}_{r}") if i else F.col(f"y0_{r}")

    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    shared = totals([e for r in range(len(n)) for e in (
        *[F.sum(F.try_divide(total(i, r) * total(j, r), F.col(f"c0_0_{r}"))) for i, j in pairs],
        F.sum(F.col(f"c0_0_{r}") ** 2), F.count_if(F.col(f"c0_0_{r}") > 0))], len(pairs) + 2)
    form = [np.zeros((p + 1, p + 1)) for _ in n]
    for r, values in enumerate(shared):
        for (i, j), v in zip(pairs, values):
            form[r][i, j] = form[r][j, i] = v
    for _ in range(max_rounds):
        old = [*su2, *se2]
        for r in range(len(n)):
            n2, groups = shared[r][-2:]
            part = np.concatenate([[1.0], -beta[r]])
            between, plain = part @ form[r] @ part, cy[r][0] - beta[r] @ c[r][0]
            ss = yy[r] - 2 * beta[r] @ cy[r] + beta[r] @ c[r] @ beta[r]
            se2[r] = max((ss - between) / max(1.0, n[r] - groups), 1e-300)
            msb = (between - plain ** 2 / n[r]) / max(1.0, groups - 1)
            n0 = (n[r] - n2 / n[r]) / max(1.0, groups - 1)
            se2[r] *= (inflation or {}).get(responses[r], 1.0)
            su2[r] = max(0.0, (msb - se2[r]) / n0) if groups > 1 and n0 > 0 else 0.0
        if all(abs(a - b) <= tol * (su2[k % len(n)] + se2[k % len(n)]) for k, (a, b) in enumerate(zip(old, [*su2, *se2]))):
            break
        weight = [F.lit(su2[r] / se2[r]) / (F.lit(se2[r]) + F.col(f"c0_0_{r}") * F.lit(su2[r])) for r in range(len(n))]
        dev = totals([F.sum(weight[r] * F.col(f"c0_{i}_{r}") * other) for r in range(len(n))
                      for i, other in [*[(i, F.col(f"c0_{j}_{r}")) for i, j in ij],
                                       *[(i, F.col(f"y0_{r}")) for i in range(p)]]], len(ij) + p)
        for r in range(len(n)):
            a = c[r] / se2[r] - square(dev[r][:len(ij)])
            cov[r] = np.linalg.pinv(a)
            beta[r] = cov[r] @ (cy[r] / se2[r] - dev[r][len(ij):])
    else:
        warnings.warn(f"variance components had not settled after {max_rounds} rounds", stacklevel=2)
    fits = {y: MixedFit(y, xs, centre, scale, beta[r], cov[r], se2[r], su2[r], int(n[r]))
            for r, y in enumerate(responses)}
    spread = [F.lit(se2[r]) + F.coalesce(F.col(f"c0_0_{r}"), F.lit(0.0)) * F.lit(su2[r]) for r in range(len(n))]
    effects = g.select(group, *[e for r, y in enumerate(responses) for e in (
        (F.coalesce(rest(r), F.lit(0.0)) * F.lit(su2[r]) / spread[r]).alias(f"u_{y}"),
        (F.lit(su2[r] * se2[r]) / spread[r]).alias(f"uvar_{y}"))])
    return fits, effects


def with_effects(df: DataFrame, fits: dict[str, MixedFit], effects: DataFrame, group: str) -> DataFrame:
    """Add fixed_<y>, u_<y> and var_<y>. A group never seen gets effect 0 with the full
    intercept variance."""
    out = df.join(effects, group, "left")
    cols = {}
    for y, fit in fits.items():
        cols[f"fixed_{y}"] = fit.fixed_mean()
        cols[f"var_{y}"] = fit.fixed_var() + F.coalesce(F.col(f"uvar_{y}"), F.lit(fit.sigma_u2))
        cols[f"u_{y}"] = F.coalesce(F.col(f"u_{y}"), F.lit(0.0))
    return out.withColumns(cols).drop(*[f"uvar_{y}" for y in fits])


def residuals(df: DataFrame, fits: dict[str, MixedFit], effects: DataFrame, group: str) -> DataFrame:
    out = with_effects(df, fits, effects, group)
    return out.withColumns({f"res_{y}": F.col(y) - F.col(f"fixed_{y}") - F.col(f"u_{y}") for y in fits})


# --- spatial and temporal dependence ----------------------------------------------------


def variogram(df: DataFrame, values: Sequence[str], x: str, y: str, block: Sequence[str], max_dist: float,
              bins: int = 15, resolution: int = 2) -> DataFrame:
    """Semivariance by distance within each block: (variable, bin, pairs, distance, gamma).
    Positions are snapped to cells, ``resolution`` to a bin. Pairs are formed between cells,
    never between rows: from n, sum and sum of squares of two cells the sum over all their row
    pairs follows exactly, and a cell has a fixed number of neighbour offsets however many rows
    it holds. All variables share the pass."""
    size = max_dist / (bins * resolution)
    reach = bins * resolution
    block, values = list(block), list(values)
    place = [F.floor(F.col(c) / F.lit(size)).alias(n) for c, n in ((x, "cx"), (y, "cy"))]
    # Meant for residuals: values near zero keep all digits in the sums of squares.
    rows = df.dropna(subset=[x, y, *block]).select(
        *block, *place, *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    cells = cut(rows.groupBy(*block, "cx", "cy").agg(*[
        f.alias(f"{n}{i}") for i in range(len(values)) for n, f in (
            ("n", F.count(f"v{i}")), ("s", F.coalesce(F.sum(f"v{i}"), F.lit(0.0))),
            ("q", F.coalesce(F.sum(F.col(f"v{i}") ** 2), F.lit(0.0))))]), "variogram-cells")
    # Cells meet through coarse squares of the reach: a cell looks into the six squares that can
    # hold a later cell within reach. A square has at most reach^2 cells, so no group is
    # unbounded, and empty places cost nothing.
    sums = [f"{n}{i}" for i in range(len(values)) for n in "nsq"]
    coarse = [F.expr(f"floor({c} / {reach})").alias(g) for c, g in (("cx", "gx"), ("cy", "gy"))]
    cells = cells.select("*", *coarse)
    one = (cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(5))))
           .selectExpr(*block, "cx AS ox", "cy AS oy", "gx + o div 3 AS gx", "gy + o % 3 - 1 AS gy",
                       *[f"{c} AS o_{c}" for c in sums]))
    near = (by_shuffle(one).join(by_shuffle(cells), [*block, "gx", "gy"])
            .filter("cx > ox OR (cx = ox AND cy > oy)")
            .withColumn("h2", F.expr("(cx - ox) * (cx - ox) + (cy - oy) * (cy - oy)")).filter(F.col("h2") < reach * reach))
    pair_sums = [f.alias(f"{n}{i}") for i in range(len(values)) for n, f in (
        ("pairs", F.sum(F.expr(f"n{i} * o_n{i}"))),
        ("d2", F.sum(F.expr(f"n{i} * o_q{i} + o_n{i} * q{i} - 2 * s{i} * o_s{i}"))))]
    between = near.groupBy("h2").agg(*pair_sums)
    same = cells.agg(*[f.alias(f"{n}{i}") for i in range(len(values)) for n, f in (
        ("pairs", F.sum(F.expr(f"n{i} * (n{i} - 1) div 2"))), ("d2", F.sum(F.expr(f"n{i} * q{i} - s{i} * s{i}"))))])
    by_h = between.unionByName(same.withColumn("h2", F.lit(0).cast("long")))
    long = by_h.select(F.sqrt(F.col("h2").cast("double")).alias("h"), F.inline(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(f"pairs{i}").alias("pairs"), F.col(f"d2{i}").alias("d2"))
        for i, v in enumerate(values)]))).filter(F.col("pairs") > 0)
    return (long.groupBy("variable", F.floor(F.col("h") / resolution).cast("int").alias("bin"))
            .agg(F.sum("pairs").alias("pairs"),
                 (F.sum(F.col("h") * F.col("pairs")) * F.lit(size) / F.sum("pairs")).alias("distance"),
                 (F.sum("d2") / F.sum("pairs") / 2).alias("gamma")))


@dataclass
class FieldModel:
    """Matern field with smoothness 1 over months with AR(1) memory."""

    variance: float
    nugget: float
    kappa: float
    rho: float = 0.0

    @property
    def nominal_range(self) -> float:
        return math.sqrt(8.0) / self.kappa

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.nominal_range, self.kappa, self.variance, self.nugget, self.rho)],
                                     "nominal_range double, kappa double, variance double, nugget double, rho double")


def matern1(t: np.ndarray) -> np.ndarray:
    """t*K1(t), the Matern correlation of smoothness 1, from the integral of
    exp(-t cosh s) cosh s over s > 0; 1 at t = 0."""
    t = np.asarray(t, float)
    s = np.linspace(0.0, 14.0, 1401)
    w = np.full(s.size, s[1])
    w[0] = w[-1] = s[1] / 2
    safe = np.maximum(t.reshape(-1, 1), 1e-4)
    k1 = (np.exp(-safe * np.cosh(s)) * np.cosh(s)) @ w
    return np.where(t < 1e-4, 1.0, t * k1.reshape(t.shape))


def fit_field(rows: Sequence, rho: float = 0.0) -> FieldModel:
    """Least squares on the collected bins of one variable, weighted by pairs: for each trial
    range the best non-negative nugget and variance."""
    if not rows:
        raise ValueError("no pair of rows within the largest distance")
    h, gamma = (np.array([r[c] for r in rows], float) for c in ("distance", "gamma"))
    w = np.sqrt(np.array([r["pairs"] for r in rows], float))
    best, top = None, max(h.max(), 1e-12)
    for reach in np.geomspace(top / 20, top * 3, 60):
        rise = 1.0 - matern1(math.sqrt(8.0) / reach * h)
        a = np.column_stack([np.ones_like(h), rise]) * w[:, None]
        sol = np.linalg.lstsq(a, gamma * w, rcond=None)[0]
        options = [sol] if (sol >= 0).all() else []
        options.append(np.array([max(0.0, (gamma * w * w).sum() / (w * w).sum()), 0.0]))
        options.append(np.array([0.0, max(0.0, (rise * w * w * gamma).sum() / max((rise * rise * w * w).sum(), 1e-300))]))
        for o in options:
            loss = float((((o[0] + o[1] * rise - gamma) * w) ** 2).sum())
            if best is None or loss < best[0]:
                best = (loss, o, reach)
    return FieldModel(float(best[1][1]), float(best[1][0]), math.sqrt(8.0) / float(best[2]), rho)


def ar1(df: DataFrame, values: Sequence[str], station: str, ym: str = "ym") -> DataFrame:
    """Correlation of consecutive months of the same station: (variable, pairs, rho). The
    previous month is met by an equi-join on (station, month), so a station with very many rows
    is spread over its months instead of being sorted in one task."""
    rows = df.select(station, ym, *[F.col(v).alias(f"now{i}") for i, v in enumerate(values)])
    before = rows.select(station, (F.col(ym) + 1).alias(ym), *[F.col(f"now{i}").alias(f"old{i}") for i in range(len(values))])
    both = [F.when(F.col(f"old{i}").isNotNull(), F.col(f"now{i}")) for i in range(len(values))]
    row = by_shuffle(rows).join(by_shuffle(before), [station, ym]).agg(*[f.alias(f"{n}{i}") for i in range(len(values)) for n, f in (
        ("n", F.count(both[i])), ("r", F.corr(f"now{i}", f"old{i}")))])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(f"n{i}").alias("pairs"), F.col(f"r{i}").alias("rho"))
        for i, v in enumerate(values)])))


# --- prediction -------------------------------------------------------------------------


def neighbours(targets: DataFrame, sources: DataFrame, target_id: str, source_id: str, k: int,
               months: int = 1) -> DataFrame:
    """The k nearest sources of each target in the same month and in each of the ``months``
    before and after: (target_id, source_id, dt, distance)."""
    lags = F.explode(F.array(*[F.lit(d) for d in range(-months, months + 1)]))
    left = targets.select(target_id, "x", "y", "ym").withColumn("dt", lags)
    right = sources.select(source_id, "x", "y", F.col("ym").alias("__at")).withColumn("dt", lags)
    right = right.withColumn("ym", F.col("__at") - F.col("dt")).drop("__at")
    return (knn_join(left, right, ["x", "y"], k, target_id, source_id, ["ym", "dt"])
            .filter(F.col(source_id).isNotNull()).select(target_id, source_id, "dt", "distance"))


def predict_field(targets: DataFrame, resid: DataFrame, models: dict[str, FieldModel], target_id: str,
                  source_id: str, k: int = 6, months: int = 1) -> DataFrame:
    """Field mean and variance per target and response: (target_id, f_<y>, fvar_<y>). Neighbours
    are shared by all responses; covariance is Matern(distance) * rho^|dt| plus nugget. A target
    without neighbours gets mean 0 and the full variance."""
    names = list(models)
    resid, source_id = resid.withColumnRenamed(source_id, "__src"), "__src"
    near = neighbours(targets, resid, target_id, source_id, k, months).select(target_id, source_id, "dt")
    values = resid.select(source_id, F.col("x").alias("nx"), F.col("y").alias("ny"),
                          *[F.col(f"res_{y}").alias(f"n{r}") for r, y in enumerate(names)])
    fields = ["nx", "ny", "dt", *[f"n{r}" for r in range(len(names))]]
    packed = (by_shuffle(near).join(by_shuffle(values), source_id)
              .groupBy(target_id).agg(F.array_sort(F.collect_list(F.struct(source_id, *fields))).alias("__nb")))
    flat = [F.expr(f"transform(__nb, s -> CAST(s.{f} AS DOUBLE))").alias(f) for f in fields]
    rows = packed.select(target_id, *flat)
    rows = by_shuffle(targets.select(target_id, "x", "y")).join(by_shuffle(rows), target_id, "left")
    shape = [models[y] for y in names]
    id_type = targets.schema[target_id].dataType.simpleString()
    schema = f"{target_id} {id_type}, " + ", ".join(f"f_{y} double, fvar_{y} double" for y in names)

    curve_t = np.concatenate([[0.0], np.geomspace(1e-4, 60.0, 4000)])
    curve = np.concatenate([matern1(t) for t in np.array_split(curve_t, 50)])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _in_slices(batches, target_id, names, shape, curve_t, curve)

    return rows.mapInPandas(solve, schema)


def _in_slices(batches: Iterator[pd.DataFrame], *how) -> Iterator[pd.DataFrame]:
    """Krige batches a bounded number of targets at a time: a target takes a dozen matrices of its neighbours."""
    for pdf in batches:
        for i in range(0, len(pdf), KRIGED):
            yield _krige(pdf.iloc[i:i + KRIGED], *how)


def _krige(pdf: pd.DataFrame, target_id: str, names: list[str], models: list[FieldModel], curve_t: np.ndarray,
           curve: np.ndarray) -> pd.DataFrame:
    """Simple kriging of some targets. Shorter neighbour lists are padded with unit rows
    that carry no weight."""
    n = len(pdf)
    size = [0 if v is None else len(v) for v in pdf["nx"]]
    width = max([1, *size])
    live = np.arange(width)[None, :] < np.array(size)[:, None]

    def table(col: str) -> np.ndarray:
        out = np.full((n, width), np.nan)
        out[live] = np.concatenate([v for v in pdf[col] if v is not None] or [np.empty(0)])
        return out

    nx, ny, dt = table("nx"), table("ny"), table("dt")
    x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
    out = {target_id: pdf[target_id]}
    for r, (name, m) in enumerate(zip(names, models)):
        v = table(f"n{r}")
        ok = live & ~np.isnan(v)
        h = np.hypot(nx[:, :, None] - nx[:, None, :], ny[:, :, None] - ny[:, None, :])
        lag = np.abs(dt[:, :, None] - dt[:, None, :])
        both = ok[:, :, None] & ok[:, None, :]
        big = np.where(both, h, 0.0) * m.kappa
        cov = m.variance * np.interp(big, curve_t, curve, right=0.0) * m.rho ** np.where(both, lag, 0.0)
        cov = np.where(both, cov, 0.0)
        diag = np.arange(width)
        cov[:, diag, diag] += np.where(ok, m.nugget + 1e-10 * max(m.variance, 1e-12), 1.0)
        h0 = np.where(ok, np.hypot(nx - x[:, None], ny - y[:, None]), 0.0) * m.kappa
        c0 = m.variance * np.interp(h0, curve_t, curve, right=0.0) * m.rho ** np.abs(np.where(ok, dt, 0.0))
        c0 = np.where(ok, c0, 0.0)
        weights = np.linalg.solve(cov, c0[:, :, None])[:, :, 0]
        out[f"f_{name}"] = (weights * np.where(ok, v, 0.0)).sum(axis=1)
        out[f"fvar_{name}"] = np.clip(m.variance - (weights * c0).sum(axis=1), 0.0, None)
    return pd.DataFrame(out)


def bands(df: DataFrame, mean: Column, var: Column, z: float = Z95) -> DataFrame:
    """pred_mean, pred_ll and pred_ul."""
    sd = F.sqrt(var)
    return df.withColumns({"pred_mean": mean, "pred_ll": mean - F.lit(z) * sd, "pred_ul": mean + F.lit(z) * sd})


@dataclass
class SurfaceModel:
    fits: dict[str, MixedFit]
    effects: DataFrame
    fields: dict[str, FieldModel]
    resid: DataFrame
    group: str


def fit_surface(stations: DataFrame, responses: Sequence[str], xs: Sequence[str], group: str, station_id: str,
                row_id: str, max_dist: float, bins: int = 15, fit: Callable = fit_many) -> SurfaceModel:
    """Fit all responses: ``stations`` holds one row per station-month with x, y, ym. The
    responses share the pass for the sums and the residual stage. ``fit`` gives the fixed effects and intercepts:
    ``fit_many``, or ``partial(fit_factors, factors=...)`` where categories are among the regressors."""
    names = [f"res_{y}" for y in responses]

    def memory(fits: dict[str, MixedFit], effects: DataFrame) -> tuple[DataFrame, dict[str, float]]:
        res = cut(residuals(stations, fits, effects, group).select(row_id, station_id, "x", "y", "ym", *names), "residuals")
        got = {r["variable"]: r["rho"] or 0.0 for r in ar1(res, names, station_id).collect()}
        return res, {y: min(0.99, max(0.0, got[f"res_{y}"])) for y in responses}

    # A first fit only measures the memory; the second allows for it.
    _, rho = memory(*fit(stations, responses, xs, group))
    fits, effects = fit(stations, responses, xs, group, inflation={y: (1 + r) / (1 - r) for y, r in rho.items()})
    effects = cut(effects, "group-effects")
    res, rho = memory(fits, effects)
    table = variogram(res, names, "x", "y", ["ym"], max_dist, bins).collect()  # bins x responses rows
    fields = {y: fit_field([r for r in table if r["variable"] == f"res_{y}"], rho[y])
              for y in responses}
    return SurfaceModel(fits, effects, fields, res, group)


def predict_surface(model: SurfaceModel, targets: DataFrame, target_id: str, row_id: str, k: int = 6,
                    months: int = 1, noise: bool = False) -> DataFrame:
    """Wide predictions per target: mean_<y>, ll_<y>, ul_<y>. The variance adds fixed effects,
    intercept and field; with ``noise`` also the nugget, for bands that should cover new
    observations instead of the underlying level."""
    field = predict_field(targets, model.resid, model.fields, target_id, row_id, k, months)
    out = by_shuffle(with_effects(targets, model.fits, model.effects, model.group)).join(by_shuffle(field), target_id)
    cols = {}
    for y, m in model.fields.items():
        mean = F.col(f"fixed_{y}") + F.col(f"u_{y}") + F.col(f"f_{y}")
        sd = F.sqrt(F.col(f"var_{y}") + F.col(f"fvar_{y}") + F.lit(m.nugget if noise else 0.0))
        cols.update({f"mean_{y}": mean, f"ll_{y}": mean - F.lit(Z95) * sd, f"ul_{y}": mean + F.lit(Z95) * sd,
                     f"sd_{y}": sd})
    drop = [f"{a}_{y}" for y in model.fields for a in ("fixed", "u", "var", "f", "fvar")]
    return out.withColumns(cols).drop(*drop)


def holdout(stations: DataFrame, responses: Sequence[str], xs: Sequence[str], group: str, station_id: str, row_id: str,
            max_dist: float, frac: float = 0.75, seed: int = 1714, k: int = 6, fit: Callable = fit_many) -> DataFrame:
    """Fit on a fixed random share, predict the masked rest, and score per response:
    (response, n, r, rmse, mae, coverage)."""
    train, test = split_exact(stations, frac, seed, [row_id])
    model = fit_surface(train, responses, xs, group, station_id, row_id, max_dist, fit=fit)
    masked = test.withColumns({y: F.lit(None).cast("double") for y in responses})
    pred = predict_surface(model, masked.drop(*responses), row_id, row_id, k, noise=True)
    both = test.select(row_id, *responses).join(pred.select(
        row_id, *[f"{a}_{y}" for y in responses for a in ("mean", "ll", "ul")]), row_id)
    cells = F.inline(F.array(*[F.struct(
        F.lit(y).alias("response"), F.col(y).alias("obs"), F.col(f"mean_{y}").alias("pred"),
        F.col(y).between(F.col(f"ll_{y}"), F.col(f"ul_{y}")).cast("double").alias("inside")) for y in responses]))
    long = both.select(cells)
    return score(long, "obs", "pred", ["response"]).join(
        long.groupBy("response").agg(F.avg("inside").alias("coverage")), "response")


def long_predictions(pred: DataFrame, base_ym: int, origin: str = "2020-01-01", ym: str = "ym") -> DataFrame:
    """(x, y, ym, statistic, value, date): the three statistics stacked, the date counted in
    months from ``origin`` at ``base_ym``."""
    long = unpivot(pred, ["x", "y", ym], ["pred_mean", "pred_ll", "pred_ul"], "statistic")
    return long.withColumn("date", F.add_months(F.lit(origin).cast("date"), (F.col(ym) - base_ym).cast("int")))


def long_surface(pred: DataFrame, responses: Sequence[str], base_ym: int, origin: str = "2020-01-01", keep: Sequence[str] = ("x", "y")) -> DataFrame:
    """Predictions of ``predict_surface`` for several responses, stacked: (*keep, ym, response, statistic, value, date), three
    statistics a response. One projection that opens each row; rows of other columns are not carried."""
    parts = [F.struct(F.lit(y).alias("response"), F.lit(f"pred_{s}").alias("statistic"), F.col(f"{s}_{y}").cast("double").alias("value"))
             for y in responses for s in ("mean", "ll", "ul")]
    date = F.add_months(F.lit(origin).cast("date"), (F.col("ym") - base_ym).cast("int"))
    return pred.select(*keep, "ym", date.alias("date"), F.explode(F.array(*parts)).alias("s")).select(*keep, "ym", "s.*", "date")


def store_predictions(long: DataFrame, path: str) -> None:
    """Write a long prediction table by statistic and year of its date, and first by response where it has one. Folders that the table has rows for are replaced, all
    others stay, so a rerun of some years leaves the rest alone and may be repeated after a failure."""
    placed = long.withColumn("year", F.year("date"))
    # Rows of a folder go to several tasks by place, so no statistic and year is one task.
    folders = [*(["response"] if "response" in long.columns else []), "statistic", "year"]
    (placed.repartition(*folders, F.pmod(F.xxhash64("x", "y"), F.lit(16))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path))


def stored_predictions(spark: SparkSession, path: str, statistic: str | None = None, years: Sequence[int] = ()) -> DataFrame:
    """Predictions as they were stored; statistic and years choose folders, the others are not read."""
    df = spark.read.parquet(path)
    df = df if statistic is None else df.filter(F.col("statistic") == statistic)
    return df.filter(F.col("year").isin(list(years))) if years else df


def month_slice(pred: DataFrame, months: Sequence[int]) -> DataFrame:
    """Rows of the given calendar months with the year and the statistic's display rank."""
    rank = F.when(F.col("statistic") == "pred_mean", 1).when(F.col("statistic") == "pred_ll", 2).otherwise(3)
    return pred.filter(F.month("date").isin(list(months))).withColumns({"year": F.year("date"), "facet": rank})


def clamp_display(pred: DataFrame, limits: tuple[float, float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Clamp to fixed limits, or to the table's own extent, with the position on the scale. With ``by`` each group has
    its own extent: one row a group is joined back. A group of one value has no position."""
    if by and limits is None:
        own = pred.groupBy(*by).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
        place = F.try_divide(F.col("value") - F.col("__lo"), F.col("__hi") - F.col("__lo"))
        return pred.join(own, list(by)).withColumns({"shown": F.col("value"), "position": place}).drop("__lo", "__hi")
    lo, hi = limits or pred.agg(F.min("value"), F.max("value")).first()
    shown = clamp("value", lo, hi)
    return pred.withColumns({"shown": shown, "position": F.try_divide(shown - F.lit(float(lo)), F.lit(float(hi - lo)))})


def fit_statistics(df: DataFrame, obs: str, pred: str, sd: str, n_params: int) -> DataFrame:
    """Gaussian log-score (mean log density) and AIC from residual moments."""
    e = F.col(obs) - F.col(pred)
    dens = -0.5 * F.ln(2 * math.pi * F.col(sd) ** 2) - e * e / (2 * F.col(sd) ** 2)
    n, rss = F.count(F.lit(1)), F.sum(e * e)
    return df.dropna(subset=[obs, pred, sd]).agg(
        n.alias("n"), F.avg(dens).alias("log_score"),
        (n * (F.ln(2 * math.pi * rss / n) + 1) + 2 * (n_params + 1)).alias("aic"))


__all__ = [
    "FieldModel", "MixedFit", "SurfaceModel", "ar1", "bands", "clamp_display", "fit_field", "fit_many",
    "fit_statistics", "fit_surface", "gram_sums", "holdout", "long_predictions", "long_surface", "matern1", "model_frame",
    "month_index", "month_slice", "store_predictions", "stored_predictions", "neighbours", "predict_field", "predict_surface", "residuals", "variogram",
    "with_effects",
]
