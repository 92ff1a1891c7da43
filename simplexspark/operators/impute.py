"""Imputation of missing parts.

``impute_knn``: nearest donors in Aitchison distance on the parts a row observes.
``impute_robust``: cyclic least-trimmed-squares regression in pivot coordinates.
Both follow Hron, Templ & Filzmoser (2010).
"""

from __future__ import annotations

import copy
import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexspark.functions.scalars import count_observed, observed
from simplexspark.functions.simplex import add_all, basis_matrix, contrast, log_part, pivot_signs, sbp_basis
from simplexspark.operators.cells import cell_knn
from simplexspark.operators.donors import nearest_donors
from simplexspark.operators.joins import null_safe_join
from simplexspark.operators.trimmed import View, Views, scales, summed, trimmed_fits
from simplexspark.sources.stages import cut

#: Sweeps that tasks take again before the table is written anew.
SWEEPS = 10


def observed_mask(parts: Sequence[str]) -> Column:
    """Bit i set when part i is observed."""
    return add_all([F.when(F.col(p).isNotNull(), F.lit(1 << i)).otherwise(0) for i, p in enumerate(parts)])


def _median(cols: Sequence[Column]) -> Column:
    """Median of up to D column values of a row, nulls skipped."""
    s = F.array_sort(F.array_compact(F.array(*cols)))
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def _bits(mask: int, d: int) -> list[int]:
    return [i for i in range(d) if mask >> i & 1]


def _blocked_candidates(df: DataFrame, parts: Sequence[str], key: Sequence[str], k: int,
                        block: Sequence[str]) -> DataFrame | None:
    """:func:`knn_candidates` within blocks, of which there may be any number."""
    parts = list(parts)
    rows = (df.select(*dict.fromkeys([*block, *key]), *[F.when(observed(p), F.col(p)).alias(p) for p in parts])
            .withColumns({"__mask": observed_mask(parts), "__row": F.struct(*key)}))
    masks = [r[0] for r in rows.filter(count_observed(parts).between(2, len(parts) - 1))
             .select("__mask").distinct().collect()]  # at most 2^D patterns
    jobs = [(o, j) for o in masks for j in range(len(parts)) if not o >> j & 1]
    if not jobs:
        return None
    # A donor is entered once, in the tree of the parts it observes. Its coordinates are its pairwise log-ratios, of which a
    # job's squared distance is a weighted sum: over the pairs of the m parts that the taker observes, divided by m. A taker
    # walks the trees of all sets of parts that hold its own and the missing one.
    d, full = len(parts), 1 << len(parts)
    pairs = list(combinations(range(d), 2))
    logs = [F.coalesce(F.ln(p), F.lit(0.0)) for p in parts]
    x = F.array(*[F.when(F.col(parts[i]).isNotNull() & F.col(parts[j]).isNotNull(), logs[i] - logs[j]).otherwise(0.0) for i, j in pairs])
    blocked = rows.dropna(subset=list(block)).withColumn("__in", F.to_json(F.struct(*block)) if block else F.lit(""))
    at = lambda mask: F.concat(F.col("__in"), F.lit("|"), mask.cast("string"))
    weights = [[1.0 / len(_bits(o, d)) if o >> i & 1 and o >> j & 1 else 0.0 for i, j in pairs] for o in masks]
    routes = [(n, o, j, m) for n, o in enumerate(masks) for j in range(d) if not o >> j & 1 for m in range(full) if m & (o | 1 << j) == o | 1 << j]
    spark = df.sparkSession
    table = spark.createDataFrame(routes, "w int, o int, j int, m int")  # at most 2^D patterns times D times 2^D sets, whatever the rows
    donors = blocked.filter(count_observed(parts) >= 3).select(F.col("__row").alias("rid"), at(F.col("__mask")).alias("root"), x.alias("x"))
    partial = rows.filter(count_observed(parts).between(2, len(parts) - 1))
    takers = blocked.filter(count_observed(parts).between(2, d - 1)).withColumn("x", x).join(table, F.col("__mask") == F.col("o"))
    takers = takers.select(F.struct("__row", "o", "j").alias("lid"), at(F.col("m")).alias("root"), "w", "x")
    near = cell_knn(takers, donors, k, len(pairs), weights).select("lid.*", F.col("rid").alias("__donor"))
    # Only the chosen donors' values are fetched, by key from the panel itself.
    value = [F.when(F.col("j") == j, F.col(p)) for j, p in enumerate(parts)]
    mid = [F.when(F.col("o") == o, _median([F.col(parts[i]) for i in _bits(o, len(parts))])) for o in masks]
    given = rows.select(F.col("__row").alias("__donor"), *parts)
    got = (near.join(given, "__donor")
           .select("__row", "o", "j", (F.coalesce(*value) / F.coalesce(*mid)).alias("ratio")))
    ratio = got.groupBy("__row", "o", "j").agg(F.array_sort(F.collect_list("ratio")).alias("s"))  # at most k values
    n = F.size("s")
    middle = (F.get("s", F.floor((n - 1) / 2).cast("int")) + F.get("s", F.floor(n / 2).cast("int"))) / 2
    own = partial.select("__row", _median([F.col(p) for p in parts]).alias("own"))
    return (ratio.withColumn("m", middle).join(own, "__row")
            .select("__row", "j", (F.col("m") * F.col("own")).alias("value"), n.alias("donors")))


def _numbered(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows with __n, a number in the order of the key."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    return cut(rows.withColumn("__n", F.monotonically_increasing_id()), "numbered")


def knn_candidates(df: DataFrame, parts: Sequence[str], key: Sequence[str], k: int = 5,
                   block: Sequence[str] = ()) -> DataFrame | None:
    """Imputed value of every missing cell of rows with at least two parts: (__row, j, value,
    donors). Only originally observed values are donors."""
    if block:
        return _blocked_candidates(df, parts, key, k, block)
    rows = _numbered(df.select(F.struct(*key).alias("__row"), *[F.when(observed(p), F.col(p)).alias(p) for p in parts]), ["__row"])
    found = nearest_donors(rows, parts, k)
    if found is None:
        return None
    cells = F.inline(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(parts) - 1)).alias("j"), F.col("__v").alias("value"), F.col("__c").alias("donors")))
    return rows.select("__n", "__row").join(found, "__n").select("__row", cells).where(F.col("donors") > 0)


def impute_knn(df: DataFrame, parts: Sequence[str], key: Sequence[str], k: int = 5,
               block: Sequence[str] = ()) -> DataFrame:
    """Fill missing parts. The value is the median over the k nearest donors of the donor's
    part, rescaled by the ratio of the two rows' medians over the parts the row observes.
    Adds ``<part>_imputed`` flags. The whole table is searched unless ``block`` narrows it.
    ``key`` must be unique. A cell without any donor stays null."""
    parts = list(parts)
    flags = {f"{p}_imputed": ~observed(p) for p in parts}
    if not block:
        rows = _numbered(df, key)
        found = nearest_donors(rows.select("__n", *[F.when(observed(p), F.col(p)).alias(p) for p in parts]), parts, k)
        if found is None:
            return df.withColumns(flags)
        out = rows.join(found, "__n", "left").withColumns(flags)
        return out.select(*[F.when(~F.col(f"{c}_imputed"), F.col(c)).otherwise(F.get("__v", F.lit(parts.index(c)))).alias(c) if c in parts
                            else F.col(c) for c in df.columns], *flags)
    cells = knn_candidates(df, parts, key, k, block)
    if cells is None:
        return df.withColumns(flags)
    wide = cells.groupBy("__row").agg(*[F.max(F.when(F.col("j") == j, F.col("value"))).alias(f"__v_{p}")
                                        for j, p in enumerate(parts)])
    out = df.withColumn("__row", F.struct(*key)).join(wide, "__row", "left").withColumns(flags)
    return out.select(*[F.when(~F.col(f"{c}_imputed"), F.col(c)).otherwise(F.col(f"__v_{c}")).alias(c) if c in parts
                        else F.col(c) for c in df.columns], *flags)


def pivot_order(parts: Sequence[str], first: str) -> list[str]:
    return [first, *[p for p in parts if p != first]]


@dataclass
class Sweeps:
    """Fills of past sweeps, taken again in each task from the values before them, so that no sweep writes the table. A batch holds the logs
    of ``d`` parts and then their flags; ``gaps`` are the places of the parts that are missing somewhere, ``bases`` their coordinates."""

    d: int
    gaps: list[int]
    bases: list[np.ndarray]
    fits: list[list[np.ndarray]] = field(default_factory=list)

    def logs(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(self.d)]).astype(float)
        return own, np.column_stack([batch.column(self.d + i).to_numpy(zero_copy_only=False) for i in range(self.d)]).astype(bool)

    def filled(self, logs: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logs after all sweeps, and before the last. Row by row the parts are filled one after another, each from the latest values
        of the others: the first pivot coordinate holds a part against their mean, and its regression is linear in their logs."""
        logs = last = logs.copy()
        for sweep in self.fits:
            last = logs.copy()
            for j, basis, fit in zip(self.gaps, self.bases, sweep):
                others = [i for i in range(self.d) if i != j]
                weights = 1.0 / len(others) + fit[1:] @ basis[1:, others] / basis[0, j]
                at = np.flatnonzero(flags[:, j])
                logs[at, j] = fit[0] / basis[0, j] + logs[np.ix_(at, others)] @ weights
        return logs, last


class SweptParts(Sweeps):
    """Splits a batch into the rows of the regressions after the sweeps, and adds up how far the last one moved the fills."""

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        own, flags = self.logs(batch)
        logs, last = self.filled(own, flags)
        whole = ~np.isnan(logs).any(axis=1)
        self.moved = getattr(self, "moved", None) or [(0, 0.0)] * len(self.gaps)
        for n, (j, basis) in enumerate(zip(self.gaps, self.bases)):
            step = (logs[:, j] - last[:, j])[flags[:, j]]
            step = step[~np.isnan(step)]
            self.moved[n] = self.moved[n][0] + len(step), self.moved[n][1] + float(step @ step)
            rows = logs[whole & ~flags[:, j]] @ basis.T
            yield n, rows[np.isfinite(rows).all(axis=1)]


class SweptViews(Views):
    """The regressions of all parts on the table after some sweeps. Starts and scales come from the table as it is."""

    def __init__(self, df: DataFrame, parts: Sequence[str], missing: Sequence[str], fits: Sequence[dict[str, np.ndarray]] = ()) -> None:
        logs = {q: F.col(q) for q in parts}
        bases = {p: sbp_basis(pivot_signs(pivot_order(parts, p))) for p in missing}
        whole = add_all([F.col(p).isNotNull().cast("int") for p in parts]) == len(parts)
        super().__init__(df, {p: View(~F.col(f"{p}_imputed") & whole, [contrast(w, logs) for w in bases[p].values()]) for p in missing})
        self.wide, self.rows = self.rows, df.select(*parts, *[f"{p}_imputed" for p in parts])
        self.how = (len(parts), [list(parts).index(p) for p in missing], [basis_matrix(b, parts).T for b in bases.values()], [[f[p] for p in missing] for f in fits])

    def long(self) -> DataFrame:
        plain = copy.copy(self)
        plain.rows = self.wide
        return Views.long(plain)

    def reader(self) -> SweptParts:
        return SweptParts(*self.how)


def _swept(state: DataFrame, parts: Sequence[str], views: SweptViews) -> DataFrame:
    """The table after the sweeps."""
    how, rest = views.how, [c for c in state.columns if c not in parts]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweeps = Sweeps(*how)
        for batch in batches:
            logs, _ = sweeps.filled(*sweeps.logs(batch.select([*parts, *[f"{p}_imputed" for p in parts]])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *[pa.array(logs[:, i], from_pandas=True) for i in range(len(parts))]], names=[*rest, *parts])

    return state.mapInArrow(fill, state.select(*rest, *parts).schema)


def impute_robust(df: DataFrame, parts: Sequence[str], key: Sequence[str], k: int = 5, max_iter: int = 50,
                  tol: float = 0.01, trim: float = 0.5, start: DataFrame | None = None) -> DataFrame:
    """Start from the kNN fill (``start``, if it is at hand), then sweep: regress the first pivot coordinate of every part on
    the others by least trimmed squares over the rows where the part was observed, all parts in the same jobs, and
    replace the missing ones by their predictions. Ends when the root mean square change of the imputed log-ratios
    falls below ``tol``; warns if that takes more than ``max_iter`` sweeps."""
    parts = list(parts)
    flags = [f"{p}_imputed" for p in parts]
    filled = impute_knn(df, parts, key, k) if start is None else start
    state = cut(filled.select(*key, *flags, *[F.ln(p).alias(p) for p in parts]), "impute")
    missing = [p for p, f in zip(parts, state.agg(*[F.max(f) for f in flags]).first()) if f]
    seen = SweptViews(state, parts, missing) if missing else None
    fits, base, table, past, worst = None, scales(seen) if missing else None, None, [], 0.0
    for _ in range(max_iter if missing else 0):
        # The first sweep settles the fits; later ones follow the filled values with a few steps each.
        fits = trimmed_fits(seen, trim, fits, base) if fits is None else trimmed_fits(seen, trim, fits, base, 3, settle=False, first=table)
        if len(past) == SWEEPS:
            state, past = cut(_swept(state, parts, seen), "impute"), []
        past.append(fits)
        seen = SweptViews(state, parts, missing, past)
        # The first step of the next sweep also says how far this one moved the fills.
        table = summed(seen, base, fits)
        worst = math.sqrt(max([s / n for n, s in seen.moved.values() if n], default=0.0))
        if worst < tol:
            break
    else:
        if missing:
            warnings.warn(f"imputed parts still moved by {worst:.3g} after {max_iter} sweeps", stacklevel=2)
    state = _swept(state, parts, seen) if missing else state
    levels = state.select(*key, *flags, *[F.exp(p).alias(f"__v_{p}") for p in parts])
    return null_safe_join(df, levels, key, "left").select(
        *[F.when(~F.col(f"{c}_imputed"), F.col(c)).otherwise(F.col(f"__v_{c}")).alias(c) if c in parts else F.col(c)
          for c in df.columns], *flags)


def compare_imputations(before: DataFrame, fills: dict[str, DataFrame], key: Sequence[str], parts: Sequence[str],
                        attributes: Sequence[str] = (), close: bool = True) -> DataFrame:
    """Long table (key, attributes, part, origin, method, value) of two or more fills of the
    same panel, closed to 1 so that they are comparable. Provenance and values are carried in
    one row per case; each fill costs one join on the key."""
    keep = list(dict.fromkeys([*key, *attributes]))
    out = before.select(*keep, *[(~observed(p)).alias(f"__na_{p}") for p in parts])
    for m, fill in fills.items():
        whole = add_all([F.col(p) for p in parts]) if close else F.lit(1.0)
        out = out.join(fill.select(*key, *[F.try_divide(F.col(p), whole).alias(f"__{m}_{p}") for p in parts]), list(key))
    cells = [F.struct(F.lit(p).alias("part"),
                      F.when(F.col(f"__na_{p}"), "Imputed").otherwise("Original").alias("origin"),
                      F.lit(m).alias("method"), F.col(f"__{m}_{p}").alias("value")) for m in fills for p in parts]
    return out.select(*keep, F.inline(F.array(*cells)))


def compare_pca(fills: dict[str, DataFrame], parts: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Stacked component scores and percentages of variance by method."""
    from simplexspark.operators.composition import clr_pca

    scores = pct = None
    for m, fill in fills.items():
        pca = clr_pca(fill, parts)
        s = pca.scores(fill, keep).withColumn("method", F.lit(m))
        v = pca.summary(fill).withColumn("method", F.lit(m))
        scores, pct = (s, v) if scores is None else (scores.unionByName(s), pct.unionByName(v))
    return scores, pct
