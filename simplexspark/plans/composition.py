"""Log-ratio operators, imputation and the outlier screen."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from simplexspark.functions import simplex as X
from simplexspark.operators import composition, impute, reshape, robust, stats
from simplexspark.operators.knn import knn_join
from simplexspark.plans.base import (
    COORD_SQL, COORDS, CTE_COMPLETE, CTE_KEPT, CTE_PANEL, CTE_STATIONS, CTE_TSPACE, KEY, PARTS, Query, SIGNS, complete,
    kept, panel, r6, r6_sql, rounded, stations, table, tspace,
)
from simplexspark.sources import cut

QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f
    return keep


_SUM = " + ".join(PARTS)
_LNS = " + ".join(f"ln({p})" for p in PARTS)


@register("closed_parts", f"WITH {CTE_COMPLETE} SELECT station, year, month, {r6_sql(*[f'{p} / ({_SUM}) AS {p}' for p in PARTS])} FROM complete")
def closed_parts(spark, sf):
    return complete(spark, sf).select(*KEY, *[r6(c).alias(p) for p, c in X.closure(PARTS).items()])


@register("centred_log_ratios", f"""WITH {CTE_COMPLETE}
SELECT station, year, month, {r6_sql(*[f'ln({p}) - ({_LNS}) / 6 AS {p}' for p in PARTS])} FROM complete""")
def centred_log_ratios(spark, sf):
    return complete(spark, sf).select(*KEY, *[r6(c).alias(p) for p, c in X.clr(PARTS).items()])


@register("balances", f"""WITH {CTE_TSPACE} SELECT station, year, month, {r6_sql('B1', 'B2', 'B3', 'B4', 'B5')} FROM tspace""")
def balances(spark, sf):
    return complete(spark, sf).select(*KEY, *[r6(c).alias(n) for n, c in X.balances(PARTS, SIGNS).items()])


@register("totals", f"WITH {CTE_TSPACE} SELECT station, year, month, {r6_sql('Total')} FROM tspace")
def totals(spark, sf):
    return complete(spark, sf).select(*KEY, r6(X.total(PARTS)).alias("Total"))


@register("tspace_panel", f"WITH {CTE_TSPACE} SELECT station, year, month, {r6_sql(*COORDS)} FROM tspace")
def tspace_panel(spark, sf):
    return rounded(tspace(spark, sf), COORDS)


@register("inverse_balances", f"WITH {CTE_COMPLETE} SELECT station, year, month, {r6_sql(*[f'{p} / ({_SUM}) AS {p}' for p in PARTS])} FROM complete")
def inverse_balances(spark, sf):
    """Coordinates back to closed parts: equals closing the parts directly."""
    z = X.to_tspace(complete(spark, sf), PARTS, SIGNS, None)
    return z.select(*KEY, *[r6(c).alias(p) for p, c in X.from_balances(PARTS, SIGNS).items()])


_D = [f"CASE WHEN a.{p} > 0 AND b.{p} > 0 THEN ln(a.{p}) - ln(b.{p}) END" for p in PARTS]


@register("aitchison_distance", f"""WITH {CTE_PANEL}, pairs AS (
  SELECT a.station, a.year, a.month, [{', '.join(_D)}] AS l FROM panel a JOIN panel b
    ON a.station = b.station AND b.year * 12 + b.month = a.year * 12 + a.month + 1),
m AS (SELECT station, year, month, list_filter(l, lambda v: v IS NOT NULL) AS l FROM pairs)
SELECT station, year, month, round(CASE WHEN len(l) >= 2 THEN sqrt(greatest(0, list_sum(list_transform(l, lambda v: (v - list_avg(l)) * (v - list_avg(l)))))) END, 6) AS distance
FROM m""")
def aitchison_distance(spark, sf):
    """Distance of each station-month to the same station's next month, on shared parts."""
    a = panel(spark, sf).withColumn("ym", F.col("year") * 12 + F.col("month"))
    b = a.select("station", (F.col("ym") - 1).alias("ym"), *[F.col(p).alias(f"b_{p}") for p in PARTS])
    d = X.aitchison({p: F.col(p) for p in PARTS}, {p: F.col(f"b_{p}") for p in PARTS})
    return a.join(b, ["station", "ym"]).select(*KEY, r6(d).alias("distance"))


@register("variation_matrix", f"WITH {CTE_COMPLETE} " + " UNION ALL ".join(
    f"SELECT '{a}' AS part_i, '{b}' AS part_j, round(var_samp(ln({a}) - ln({b})), 6) AS value FROM complete"
    for a, b in permutations(PARTS, 2)))
def variation_matrix(spark, sf):
    return rounded(composition.variation_matrix(complete(spark, sf), PARTS), ["value"])


_CLR = ", ".join(f"ln({p}) - ({_LNS}) / 6 AS {p}" for p in PARTS)


@register("clr_covariance", f"WITH {CTE_COMPLETE}, c AS (SELECT {_CLR} FROM complete) " + " UNION ALL ".join(
    f"SELECT '{a}' AS i, '{b}' AS j, round(avg({a}), 6) AS mean_i, round(avg({b}), 6) AS mean_j, round(covar_pop({a}, {b}), 6) AS cov FROM c"
    for k, a in enumerate(PARTS) for b in PARTS[k:]))
def clr_covariance(spark, sf):
    logs = complete(spark, sf).select(*[c.alias(p) for p, c in X.clr(PARTS).items()])
    return rounded(composition.covariance(logs, PARTS), ["mean_i", "mean_j", "cov"])


@register("clr_components", None)
def clr_components(spark, sf):
    rows = complete(spark, sf)
    return composition.clr_pca(rows, PARTS).summary(rows)


@register("component_total_variance", f"""WITH {CTE_COMPLETE}, c AS (SELECT {_CLR} FROM complete)
SELECT round({' + '.join(f'var_pop({p})' for p in PARTS)}, 6) AS total_variance, 100e0 AS pct FROM c""")
def component_total_variance(spark, sf):
    """Component variances add up to the total clr variance, percentages to 100."""
    rows = complete(spark, sf)
    s = composition.clr_pca(rows, PARTS).summary(rows)
    return s.agg(r6(F.sum(F.col("sd") * F.col("sd"))).alias("total_variance"), r6(F.sum("pct_variance")).alias("pct"))


@register("component_scores", None)
def component_scores(spark, sf):
    rows = complete(spark, sf)
    return composition.clr_pca(rows, PARTS).scores(rows, KEY)


@register("biplot_table", None)
def biplot_table(spark, sf):
    from simplexspark.functions.scalars import interaction

    rows = complete(spark, sf).join(stations(spark, sf), "station").withColumn("group", interaction("station_type", "area"))
    return composition.biplot(rows, PARTS, "group")


# --- nearest compositions and imputation ------------------------------------------------

_HAS = [f"CAST(({p} IS NOT NULL) AS INTEGER)" for p in PARTS]
_L = [f"t.h{i} * (t.a{i} - d.a{i})" for i in range(6)]
CTE_CELLS = f"""base AS (
  SELECT station, year, month, row_number() OVER (ORDER BY station, year, month) AS rid, [{', '.join(PARTS)}] AS p,
    {' + '.join(f'{h} * {1 << i}' for i, h in enumerate(_HAS))} AS mask, {' + '.join(_HAS)} AS m,
    {', '.join(f'{h} AS h{i}, coalesce(ln({p}), 0) AS a{i}' for i, (h, p) in enumerate(zip(_HAS, PARTS)))} FROM kept),
 takers AS (SELECT * FROM (SELECT *, unnest(range(6)) AS j FROM base WHERE m < 6) WHERE (mask >> j) & 1 = 0),
 found AS (SELECT t.rid, t.j, unnest(arg_min(d.rid, {' + '.join(f'pow({x}, 2)' for x in _L)} - pow({' + '.join(_L)}, 2) / t.m, 5)) AS donor
  FROM takers t JOIN base d ON (d.mask & (t.mask | (1 << t.j))) = (t.mask | (1 << t.j)) GROUP BY t.rid, t.j),
 best AS (SELECT f.rid, f.j, t.station, t.year, t.month, t.p AS tp, d.p AS dp, list_filter(range(1, 7), lambda i: t.p[i] IS NOT NULL) AS o
  FROM found f JOIN base t ON t.rid = f.rid JOIN base d ON d.rid = f.donor)"""


@register("knn_imputed_cells", f"""WITH {CTE_KEPT}, {CTE_CELLS}
SELECT station, year, month, CAST(j AS INTEGER) AS part, CAST(count(*) AS INTEGER) AS donors,
  round(median(dp[j + 1] / list_median(list_transform(o, lambda i: dp[i]))) * any_value(list_median(list_transform(o, lambda i: tp[i]))), 4) AS value
FROM best GROUP BY station, year, month, j""")
def knn_imputed_cells(spark, sf):
    """Every missing cell of the whole panel filled from its five nearest donors."""
    cells = impute.knn_candidates(kept(spark, sf), PARTS, KEY, 5)
    return cells.select("__row.*", F.col("j").alias("part"), "donors", F.round("value", 4).alias("value"))


@register("nearest_compositions", None)
def nearest_compositions(spark, sf):
    """Three nearest complete compositions of every incomplete one that observes at least the
    first three parts, on those parts."""
    seen = PARTS[:3]
    z = X.balances(seen, X.pivot_signs(seen))
    rows = kept(spark, sf).dropna(subset=seen).withColumns({"row": F.struct(*KEY), **z})
    full = rows.dropna(subset=PARTS)
    left = rows.filter(X.add_all([F.col(p).isNull().cast("int") for p in PARTS]) > 0)
    near = knn_join(left, full.withColumnRenamed("row", "donor"), list(z), 3, "row", "donor")
    return near.select("row.*", F.col("donor.station").alias("d_station"), F.col("donor.year").alias("d_year"),
                       F.col("donor.month").alias("d_month"), r6("distance").alias("distance"), "rank")


QUERIES["nearest_compositions"] = (nearest_compositions, f"""WITH {CTE_KEPT},
 z AS (SELECT *, sqrt(2e0/3) * (ln(p_af) - (ln(p_ao) + ln(p_nf)) / 2) AS z1, sqrt(5e-1) * ln(p_ao / p_nf) AS z2
   FROM kept WHERE p_af IS NOT NULL AND p_ao IS NOT NULL AND p_nf IS NOT NULL),
 d AS (SELECT * FROM z WHERE p_no IS NOT NULL AND p_rf IS NOT NULL AND p_ro IS NOT NULL),
 t AS (SELECT * FROM z WHERE p_no IS NULL OR p_rf IS NULL OR p_ro IS NULL),
 pairs AS (SELECT t.station, t.year, t.month, d.station AS d_station, d.year AS d_year, d.month AS d_month,
    sqrt((t.z1 - d.z1) * (t.z1 - d.z1) + (t.z2 - d.z2) * (t.z2 - d.z2)) AS distance FROM t CROSS JOIN d)
SELECT station, year, month, d_station, d_year, d_month, round(distance, 6) AS distance,
  CAST(row_number() OVER (PARTITION BY station, year, month ORDER BY distance, d_station, d_year, d_month) AS INTEGER) AS rank
FROM pairs QUALIFY rank <= 3""")


@register("imputed_panel", None)
def imputed_panel(spark, sf):
    """Attributes, filled parts and their provenance flags."""
    filled = impute.impute_knn(kept(spark, sf), PARTS, KEY, 5)
    return filled.join(stations(spark, sf).select("station", "station_type", "area"), "station")


@register("robust_imputed_panel", None)
def robust_imputed_panel(spark, sf):
    return impute.impute_robust(kept(spark, sf), PARTS, KEY, 5)


def _fills(spark, sf):
    """Fills of the panel: nearest donors, the robust fill that starts from them, and beside these the geometric mean of the
    observed parts."""
    from simplexspark.sources import cut

    before = cut(kept(spark, sf), "panel")
    knn = cut(impute.impute_knn(before, PARTS, KEY, 5), "filled")
    lts = cut(impute.impute_robust(before, PARTS, KEY, 5, start=knn), "robust")
    gm = F.exp(F.try_divide(X.add_all([F.coalesce(F.ln(p), F.lit(0.0)) for p in PARTS]),
                            X.add_all([F.col(p).isNotNull().cast("int") for p in PARTS])))
    mean = before.select(*KEY, *[F.coalesce(F.col(p), gm).alias(p) for p in PARTS])
    return before, {"KNN": knn, "LTS": lts, "GM": mean}


@register("imputation_comparison", None)
def imputation_comparison(spark, sf):
    """Box statistics of the fills by part, method, provenance, station type and area."""
    before, fills = _fills(spark, sf)
    before = before.join(stations(spark, sf).select("station", "station_type", "area"), "station")
    long = impute.compare_imputations(before, fills, KEY, PARTS, ["station_type", "area"])
    return stats.box_stats(long, ["part", "method", "origin", "station_type", "area"], "value")


@register("imputation_components", None)
def imputation_components(spark, sf):
    """Percentage of variance of the clr components of the fills."""
    _, fills = _fills(spark, sf)
    return impute.compare_pca(fills, PARTS, KEY)[1]


@register("original_cells_compared", f"""WITH {CTE_COMPLETE}, {CTE_STATIONS}, closed AS (
  SELECT station, year, month, station_type, area, unnest([{', '.join(f"{{'part': '{p}', 'value': {p} / ({_SUM})}}" for p in PARTS)}]) AS c
  FROM complete JOIN stations USING (station))
SELECT station, year, month, station_type, area, c.part AS part, 'Original' AS origin, m AS method, round(c.value, 6) AS value
FROM closed, unnest(['A', 'B']) t(m)""")
def original_cells_compared(spark, sf):
    """Long comparison frame on complete rows, where both fills are the data themselves."""
    rows = complete(spark, sf)
    before = rows.join(stations(spark, sf).select("station", "station_type", "area"), "station")
    return rounded(impute.compare_imputations(before, {"A": rows, "B": rows}, KEY, PARTS, ["station_type", "area"]), ["value"])


# --- outlier screen ---------------------------------------------------------------------


@register("outlier_screen", None)
def outlier_screen(spark, sf):
    rows = complete(spark, sf)
    model = robust.fit_outliers(rows, PARTS, SIGNS)
    return robust.flag_outliers(rows, model).select(*KEY, "d2", "outlier", "outlier_bin", "outlier_code", "outlier_cause")


def screened(spark, sf):
    """The filled panel with its number of observed parts, flagged by the fitted screen."""
    filled = cut(impute.impute_knn(stats.n_observed(kept(spark, sf), PARTS), PARTS, KEY, 5), "filled")
    # Cut before anything is filtered or grouped by the flags: their expressions would be repeated in every use.
    flags = cut(robust.flag_outliers(filled, robust.fit_outliers(filled, PARTS, SIGNS)).select(*KEY, "n_observed", "outlier", "outlier_cause"), "flags")
    return flags.join(stations(spark, sf).select("station", "station_type", "area"), "station")


@register("screened_outliers", None)
def screened_outliers(spark, sf):
    """Shares, observed parts, causes, rows kept and rates by area and type, from the fitted screen of the filled panel."""
    return rounded(robust.screen_tables(screened(spark, sf), ["area", "station_type"]), ["value"])


CODE_SQL = f"""{CTE_COMPLETE}, coded AS (SELECT station, year, month,
  CASE WHEN p_af + p_ao + p_nf < 90000 THEN 'ok' ELSE {' || '.join(f"CAST(({p} > 60000)::INTEGER AS VARCHAR)" for p in PARTS)} END AS outlier_code FROM complete)"""


@register("outlier_causes", f"""WITH {CODE_SQL}
SELECT station, year, month, outlier_code, CASE outlier_code WHEN 'ok' THEN 'No outlier' ELSE 'Outlier' END AS outlier,
  CASE outlier_code WHEN 'ok' THEN 0 ELSE 1 END AS outlier_bin,
  CASE outlier_code WHEN 'ok' THEN 'ok' WHEN '000000' THEN '?' ELSE concat_ws('_', {', '.join(f"CASE WHEN outlier_code[{i}] = '1' THEN '{p}' END" for i, p in enumerate(PARTS, 1))}) END AS outlier_cause
FROM coded""")
def outlier_causes(spark, sf):
    code = F.when(F.col("p_af") + F.col("p_ao") + F.col("p_nf") < 90000, "ok").otherwise(
        F.concat(*[(F.col(p) > 60000).cast("int").cast("string") for p in PARTS]))
    return robust.attach_cause(complete(spark, sf).select(*KEY, code.alias("outlier_code")), PARTS)


@register("centre_distances", f"""WITH {CTE_TSPACE}, m AS (SELECT {', '.join(f'avg({b}) AS m{b}, stddev_samp({b}) AS s{b}' for b in COORDS[1:])} FROM tspace)
SELECT station, year, month, round({' + '.join(f'pow(({b} - m{b}) / s{b}, 2)' for b in COORDS[1:])}, 6) AS d2 FROM tspace, m""")
def centre_distances(spark, sf):
    """Squared distance under a diagonal scatter, the plain-SQL case of the distance Column."""
    import numpy as np

    rows = tspace(spark, sf)
    mean, cov = composition.moments(rows, COORDS[1:], sample=True)
    return rows.select(*KEY, r6(robust.mahalanobis2(COORDS[1:], mean, np.diag(np.diag(cov)))).alias("d2"))
