"""Fixed effects of numbers and categories together, with place intercepts.

A category never becomes one column per level. A row holds a handful of terms (the intercept, its numbers, and for each
factor the level it has), so the Gram matrix is kept as triples (term, term, value): first summed by place and combination of
levels, then by pair of terms. Only the triples reach the driver, and the number of levels is checked before.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexspark.functions.simplex import add_all
from simplexspark.operators.surface import Z95, gram_sums
from simplexspark.sources.stages import cut

#: Levels of all factors together. The normal equations are solved on the driver, so they must stay a small matrix.
MAX_LEVELS = 1000
#: Name of the response among the terms of the Gram triples.
ANSWER = ""


def level_term(factor: str, level: str) -> str:
    return f"{factor}={level}"


@dataclass
class FactorFit:
    """Coefficients of one response: on centred and scaled numbers, with treatment contrasts against the first level of
    each factor. ``levels`` holds all levels, the base first. Has the interface of ``MixedFit``."""

    response: str
    xs: list[str]
    levels: dict[str, list[str]]
    slopes: dict[str, list[str]]
    centre: np.ndarray
    scale: np.ndarray
    terms: list[tuple[int, str, str]]
    beta: np.ndarray
    cov: np.ndarray
    sigma_e2: float
    sigma_u2: float
    n: int
    places: dict[tuple[int, str, str], int] = field(init=False)

    def __post_init__(self) -> None:
        self.places = {t: k for k, t in enumerate(self.terms)}

    def _z(self, i: int) -> Column:
        return F.lit(1.0) if i == 0 else (F.col(self.xs[i - 1]) - F.lit(float(self.centre[i - 1]))) / F.lit(float(self.scale[i - 1]))

    def _parts(self) -> list[tuple[int, str]]:
        """(number, factor) of the terms that a row holds, factor "" for the plain ones."""
        return list(dict.fromkeys((i, f) for i, f, _ in self.terms))

    def _by_level(self, values: dict[str, float], factor: str) -> Column:
        """Number of the row's level: 0 for the base, null for a level that the fit has not seen."""
        known = [F.lit(v) for level in self.levels[factor] for v in (level, float(values.get(level, 0.0)))]
        return F.element_at(F.create_map(*known), F.col(factor).cast("string"))

    def fixed_mean(self) -> Column:
        """Mean of a row. Null where a number or a factor is null or a level was not in the fit."""
        out = []
        for i, f in self._parts():
            if f:
                out.append(self._z(i) * self._by_level({v: self.beta[k] for (j, g, v), k in self.places.items() if (j, g) == (i, f)}, f))
            else:
                out.append(self._z(i) * F.lit(float(self.beta[self.places[i, "", ""]])))
        return add_all(out)

    def fixed_var(self) -> Column:
        """Variance of the fixed mean of a row: its terms on either side of their covariance."""
        out, parts = [], self._parts()
        for a, (i, f) in enumerate(parts):
            for b in range(a, len(parts)):
                j, g = parts[b]
                times = self._z(i) * self._z(j) * F.lit(1.0 if a == b else 2.0)
                out.append(times * self._cov(i, f, j, g))
        return add_all(out)

    def _cov(self, i: int, f: str, j: int, g: str) -> Column:
        def at(v: str, w: str) -> float:
            a, b = self.places.get((i, f, v)), self.places.get((j, g, w))
            return 0.0 if a is None or b is None else float(self.cov[a, b])

        if not f and not g:
            return F.lit(at("", ""))
        if f == g:
            return self._by_level({v: at(v, v) for v in self.levels[f]}, f)
        if not f or not g:
            own = f or g
            return self._by_level({v: at(v if f else "", v if g else "") for v in self.levels[own]}, own)
        rows = [F.lit(v) if k == 0 else F.create_map(*[F.lit(u) for w in self.levels[g] for u in (w, at(v, w))])
                for v in self.levels[f] for k in (0, 1)]
        return F.element_at(F.element_at(F.create_map(*rows), F.col(f).cast("string")), F.col(g).cast("string"))

    def table(self, spark: SparkSession) -> DataFrame:
        """(term, mean, sd, q025, q975) on the numbers' own scale. ``area=rural`` is the difference of that level's
        intercept from the base's, ``altitude:area=rural`` that of its slope."""
        back = np.eye(len(self.terms))
        for (i, f, v), k in self.places.items():
            if i:
                back[k, k] = 1 / self.scale[i - 1]
                back[self.places[0, f, v], k] = -self.centre[i - 1] / self.scale[i - 1]
        mean, sd = back @ self.beta, np.sqrt(np.maximum(0, np.diag(back @ self.cov @ back.T)))
        names = [":".join(([self.xs[i - 1]] if i else []) + ([level_term(f, v)] if f else [])) or "intercept" for i, f, v in self.terms]
        rows = [(t, float(m), float(s), float(m - Z95 * s), float(m + Z95 * s)) for t, m, s in zip(names, mean, sd)]
        return spark.createDataFrame(rows, "term string, mean double, sd double, q025 double, q975 double")


def find_levels(combos: DataFrame, factors: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Levels of each factor in order; the first is the base. Raises if there are more than ``max_levels`` in all."""
    if not factors:
        return {}
    long = combos.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])).alias("s")).select("s.*").distinct()
    found = sorted(tuple(r) for r in long.limit(max_levels + 1).collect())
    if len(found) > max_levels:
        raise ValueError(f"more than {max_levels} levels in {', '.join(factors)}: use the factor as the group instead")
    return {f: [v for g, v in found if g == f] for f in factors}


def fit_factors(df: DataFrame, responses: Sequence[str], xs: Sequence[str], group: str, factors: Sequence[str],
                slopes: dict[str, Sequence[str]] | None = None, max_rounds: int = 100, tol: float = 1e-5,
                inflation: dict[str, float] | None = None, max_levels: int = MAX_LEVELS) -> tuple[dict[str, FactorFit], DataFrame]:
    """Generalised least squares on numbers ``xs`` and ``factors`` with a random intercept per ``group``, for all responses at
    once; ``slopes`` names, by factor, the numbers whose slope differs by level. Variance components are moments between and within
    groups, refreshed with the coefficients until they settle to ``tol``. Also returns the group effects, as ``fit_many`` does.

    The rows are read twice: once for centres and scales, once for sums by group and combination of levels. From these come the
    triples of the Gram matrix and, by group size, those of the products of group totals; a round is one job over the latter.
    Rows with a null number, factor or group take no part, nor does a row in a response that it has not. A level that is
    never seen with a response, or a term that others determine, gets the least-norm solution.
    """
    xs, responses, factors = list(xs), list(responses), list(factors)
    slopes = {f: list((slopes or {}).get(f, [])) for f in factors}
    df = df.dropna(subset=[*xs, *factors, group])
    row = df.agg(F.count(F.lit(1)), *[f(x) for x in xs for f in (F.avg, F.stddev_pop)]).first()
    if not row[0]:
        raise ValueError("no row has all regressors")
    centre, scale = np.array(row[1::2], float), np.array(row[2::2], float)
    for x, s in zip(xs, scale):
        if not s > 0:
            raise ValueError(f"regressor {x} is constant or empty")
    combos = cut(gram_sums(df, responses, xs, [group, *factors], centre, scale), "factor-sums")
    levels = find_levels(combos, factors, max_levels)

    # The terms of a combination, in a fixed order: their number is that of the formula, not that of the levels.
    parts = [(i, "") for i in range(len(xs) + 1)] + [(i, f) for f in factors for i in (0, *[1 + xs.index(x) for x in slopes[f]])]

    def name(i: int, f: str) -> Column:
        return F.concat(F.lit(f"{i}|{f}|"), F.col(f).cast("string")) if f else F.lit(f"{i}||")

    def cell(i: int, j: int, r: int) -> Column:
        return F.col(f"c{min(i, j)}_{max(i, j)}_{r}")

    base = {f"{i}|{f}|{levels[f][0]}" for i, f in parts if f}
    pairs = []
    for r in range(len(responses)):
        for a, (i, f) in enumerate(parts):
            pairs += [(r, name(i, f), name(j, g), cell(i, j, r)) for j, g in parts[a:]]
            pairs.append((r, name(i, f), F.lit(ANSWER), F.col(f"y{i}_{r}")))
        pairs.append((r, F.lit(ANSWER), F.lit(ANSWER), F.col(f"yy_{r}")))
    triples = combos.select(F.explode(F.array(*[F.struct(F.lit(r).alias("r"), a.alias("a"), b.alias("b"), v.alias("v")) for r, a, b, v in pairs])).alias("s")).select("s.*")
    gram = triples.where("v <> 0").groupBy("r", "a", "b").agg(F.sum("v").alias("v")).collect()

    # Totals of every group by term, then their products summed by group size: the weight of a group depends on its size alone.
    totals = [F.struct(F.lit(r).alias("r"), F.col(f"c0_0_{r}").alias("rows"), t.alias("term"), v.alias("v"))
              for r in range(len(responses))
              for t, v in [*[(name(i, f), cell(0, i, r)) for i, f in parts], (F.lit(ANSWER), F.col(f"y0_{r}"))]]
    sums = combos.select(group, F.explode(F.array(*totals)).alias("s")).select(group, "s.*").where("rows > 0")
    sums = cut(sums.groupBy("r", group, "term").agg(F.sum("v").alias("v")), "factor-totals")
    size = sums.where(F.col("term") == "0||").select("r", group, F.col("v").alias("size"))
    held = sums.where(~F.col("term").isin(*base) if base else F.lit(True)).where("v <> 0")
    other = held.select("r", group, F.col("term").alias("b"), F.col("v").alias("w"))
    products = held.withColumnRenamed("term", "a").join(other, ["r", group]).where("a <= b").join(size, ["r", group])
    products = cut(products.groupBy("r", "a", "b", "size").agg(F.sum(F.col("v") * F.col("w")).alias("v")), "factor-products")
    sizes = {r["r"]: r for r in size.groupBy("r").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("size") ** 2).alias("n2")).collect()}

    terms = [(i, "", "") for i in range(len(xs) + 1)]
    terms += [(i, f, v) for f in factors for v in levels[f][1:] for i in (0, *[1 + xs.index(x) for x in slopes[f]])]
    place = {f"{i}|{f}|{v}": k for k, (i, f, v) in enumerate(terms)} | {ANSWER: len(terms)}
    p = len(terms)

    def matrices(rows: list, column: str = "v") -> list[np.ndarray]:
        out = [np.zeros((p + 1, p + 1)) for _ in responses]
        for t in rows:
            if t["a"] in place and t["b"] in place:
                out[t["r"]][place[t["a"]], place[t["b"]]] = out[t["r"]][place[t["b"]], place[t["a"]]] = t[column]
        return out

    full = matrices(gram)
    shared = matrices(products.groupBy("r", "a", "b").agg(F.sum(F.col("v") / F.col("size")).alias("v")).collect())
    for r, y in enumerate(responses):
        if not full[r][0, 0] > 0:
            raise ValueError(f"response {y} is empty")
    beta = [np.linalg.lstsq(m[:p, :p], m[:p, p], rcond=None)[0] for m in full]
    su2, se2, cov = [0.0] * len(full), [0.0] * len(full), [np.eye(p)] * len(full)
    for _ in range(max_rounds):
        old = [*su2, *se2]
        for r, m in enumerate(full):
            groups, n2, n = sizes[r]["groups"], sizes[r]["n2"], m[0, 0]
            part = np.concatenate([-beta[r], [1.0]])
            between, plain = part @ shared[r] @ part, part @ m[:, 0]
            se2[r] = max((part @ m @ part - between) / max(1.0, n - groups), 1e-300)
            msb = (between - plain ** 2 / n) / max(1.0, groups - 1)
            n0 = (n - n2 / n) / max(1.0, groups - 1)
            se2[r] *= (inflation or {}).get(responses[r], 1.0)
            su2[r] = max(0.0, (msb - se2[r]) / n0) if groups > 1 and n0 > 0 else 0.0
        if all(abs(a - b) <= tol * (su2[k % len(full)] + se2[k % len(full)]) for k, (a, b) in enumerate(zip(old, [*su2, *se2]))):
            break
        own = [F.when(F.col("r") == r, F.lit(su2[r] / se2[r]) / (F.lit(se2[r]) + F.col("size") * F.lit(su2[r]))) for r in range(len(full))]
        shrunk = matrices(products.groupBy("r", "a", "b").agg(F.sum(F.coalesce(*own) * F.col("v")).alias("v")).collect())
        for r, m in enumerate(full):
            a = m / se2[r] - shrunk[r]
            cov[r] = np.linalg.pinv(a[:p, :p], hermitian=True)
            beta[r] = cov[r] @ a[:p, p]
    else:
        warnings.warn(f"variance components had not settled after {max_rounds} rounds", stacklevel=2)
    fits = {y: FactorFit(y, xs, levels, slopes, centre, scale, terms, beta[r], cov[r], se2[r], su2[r], int(full[r][0, 0])) for r, y in enumerate(responses)}

    # Group effects: the rest of a group's total, shrunk. Coefficients join the totals by term.
    weights = [(r, t, 1.0 if t == ANSWER else -float(beta[r][k])) for r in range(len(full)) for t, k in place.items()]
    rest = sums.join(sums.sparkSession.createDataFrame(weights, "r int, term string, coef double"), ["r", "term"])
    rest = rest.groupBy(group, "r").agg(F.sum(F.col("coef") * F.col("v")).alias("rest")).join(size, ["r", group])
    flat = []
    for r, y in enumerate(responses):
        spread = F.lit(se2[r]) + F.col("size") * F.lit(su2[r])
        flat += [F.max(F.when(F.col("r") == r, F.col("rest") * F.lit(su2[r]) / spread)).alias(f"u_{y}"),
                 F.max(F.when(F.col("r") == r, F.lit(su2[r] * se2[r]) / spread)).alias(f"uvar_{y}")]
    effects = rest.groupBy(group).agg(*flat)
    for r, y in enumerate(responses):
        effects = effects.withColumns({f"u_{y}": F.coalesce(f"u_{y}", F.lit(0.0)), f"uvar_{y}": F.coalesce(f"uvar_{y}", F.lit(su2[r]))})
    return fits, effects
