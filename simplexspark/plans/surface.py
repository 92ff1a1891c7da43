"""Exposure-surface steps and the whole run for six responses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from simplexspark.operators import surface as M
from simplexspark.operators.factors import fit_factors
from simplexspark.plans.base import (
    COORDS, CTE_STATIONS, CTE_TSPACE, KEY, Query, r6, r6_sql, rounded, stacked, stations, tspace,
)
from simplexspark.plans.panel import CTE_COVARIATES, covariate_frame
from simplexspark.plans.spatial import lattice_frame
from simplexspark.sources import cut
from simplexspark.sources.stages import scratch_root

QUERIES: dict[str, Query] = {}
XS = ["altitude", "temp_max", "temp_min"]
MAX_DIST = 3000.0


def register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f
    return keep


def station_rows(spark, sf):
    """Station-months with coordinates, position, covariates and group."""
    st = stations(spark, sf).select("station", "municipality", "county", "altitude", "x", "y")
    cov = covariate_frame(spark, sf).select(F.col("name").alias("municipality"), "year", "month", "temp_max", "temp_min")
    rows = tspace(spark, sf).join(st, "station").join(cov, ["municipality", "year", "month"], "left")
    ym = F.col("year") * 12 + F.col("month")
    return rows.withColumns({"ym": ym, "row_id": F.col("station") * 100000 + ym}).drop("municipality")


CTE_ROWS = f"""{CTE_TSPACE}, {CTE_COVARIATES}, rows_ AS (
  SELECT p.*, s.county, s.altitude, s.x, s.y, c.temp_max, c.temp_min, CAST(p.year * 12 + p.month AS INTEGER) AS ym,
    p.station * 100000 + p.year * 12 + p.month AS row_id
  FROM tspace p JOIN stations s USING (station) LEFT JOIN covariates c ON c.name = s.municipality AND c.year = p.year AND c.month = p.month)"""


@register("model_rows", f"""WITH {CTE_ROWS}
SELECT 'est' AS tag, {r6_sql('Total', 'B1')}, county, round(altitude, 6) AS altitude, round(temp_max, 6) AS temp_max, ym FROM rows_
UNION ALL SELECT 'pred', NULL, NULL, county, round(altitude, 6), round(temp_max, 6), ym + 12 FROM rows_""")
def model_rows(spark, sf):
    """Observed rows and the same places a year later, to be predicted."""
    rows = station_rows(spark, sf)
    out = M.model_frame(rows, rows.withColumn("ym", F.col("ym") + 12), ["Total", "B1"], ["county", "altitude", "temp_max", "ym"])
    return rounded(out, ["Total", "B1", "altitude", "temp_max"])


@register("gram_sums", f"""WITH {CTE_ROWS}
SELECT county, round(sum(1e0), 6) AS n, {r6_sql('sum((altitude - 5000) / 1000) AS s1', 'sum((altitude - 5000) / 1000 * B1) AS s1y', 'sum(B1) AS sy', 'sum(B1 * B1) AS yy')}
FROM rows_ WHERE temp_max IS NOT NULL GROUP BY ALL""")
def gram_sums(spark, sf):
    g = M.gram_sums(station_rows(spark, sf).dropna(subset=["temp_max"]), ["B1"], ["altitude"], "county", [5000.0], [1000.0])
    return g.select("county", r6("c0_0_0").alias("n"), r6("c0_1_0").alias("s1"), r6("y1_0").alias("s1y"), r6("y0_0").alias("sy"),
                    r6("yy_0").alias("yy"))


@register("fixed_effects", None)
def fixed_effects(spark, sf):
    """Coefficient table of all six responses."""
    fits, _ = M.fit_many(station_rows(spark, sf), COORDS, XS, "county")
    out = None
    for y, fit in fits.items():
        t = fit.table(spark).withColumn("response", F.lit(y))
        out = t if out is None else out.unionByName(t)
    return out


@register("single_slope", f"WITH {CTE_ROWS} SELECT round(regr_slope(Total, altitude), 9) AS slope, round(regr_intercept(Total, altitude), 6) AS intercept FROM rows_")
def single_slope(spark, sf):
    """One regressor and one group reduce to the ordinary slope."""
    fits, _ = M.fit_many(station_rows(spark, sf).withColumn("all", F.lit(1)), ["Total"], ["altitude"], "all")
    t = fits["Total"].table(spark)
    return t.agg(F.round(F.max(F.when(F.col("term") == "altitude", F.col("mean"))), 9).alias("slope"),
                 r6(F.max(F.when(F.col("term") == "intercept", F.col("mean")))).alias("intercept"))


@register("place_intercepts", None)
def place_intercepts(spark, sf):
    _, effects = M.fit_many(station_rows(spark, sf), COORDS, XS, "county")
    return effects


def classed_rows(spark, sf):
    """Station-months with urban class and type beside the numbers, rain among them."""
    st = stations(spark, sf).select("station", "station_type", "area", "municipality")
    rain = covariate_frame(spark, sf).select(F.col("name").alias("municipality"), "year", "month", "rain")
    return station_rows(spark, sf).join(st, "station").join(rain, ["municipality", "year", "month"], "left")


def coefficients(spark, fits, columns):
    """The tables of all responses in one."""
    out = None
    for y, fit in fits.items():
        t = fit.table(spark).select(F.lit(y).alias("response"), *columns)
        out = t if out is None else out.unionByName(t)
    return out


@register("class_slopes", f"""WITH {CTE_ROWS}, s AS (SELECT u.variable AS response, area, regr_slope(u.value, r.altitude) AS b, regr_intercept(u.value, r.altitude) AS a
   FROM (SELECT *, unnest({stacked(COORDS)}) AS u FROM rows_) r JOIN stations USING (station) GROUP BY ALL),
 z AS (SELECT response, min(area) AS base FROM s GROUP BY ALL), d AS (SELECT s.*, z.base, t.a AS a0, t.b AS b0 FROM s JOIN z USING (response) JOIN s t ON t.response = s.response AND t.area = z.base)
SELECT response, CASE WHEN area = base THEN 'intercept' ELSE 'area=' || area END AS term, round(CASE WHEN area = base THEN a ELSE a - a0 END, 6) AS mean FROM d
UNION ALL SELECT response, CASE WHEN area = base THEN 'altitude' ELSE 'altitude:area=' || area END, round(1000 * CASE WHEN area = base THEN b ELSE b - b0 END, 6) FROM d""")
def class_slopes(spark, sf):
    """Intercept and slope on altitude (per 1000) by urban class, all six responses. In one group that is a regression in each class."""
    rows = classed_rows(spark, sf).withColumn("all", F.lit(1))
    fits, _ = fit_factors(rows, COORDS, ["altitude"], "all", ["area"], {"area": ["altitude"]})
    mean = F.when(F.col("term").startswith("altitude"), F.col("mean") * 1000).otherwise(F.col("mean"))
    return coefficients(spark, fits, ["term", r6(mean).alias("mean")])


@register("class_effects", None)
def class_effects(spark, sf):
    """Coefficients of all six responses with urban class, station type and rain, beside county intercepts."""
    fits, _ = fit_factors(classed_rows(spark, sf), COORDS, [*XS, "rain"], "county", ["area", "station_type"])
    return coefficients(spark, fits, ["term", "mean", "sd", "q025", "q975"])


_CELL = MAX_DIST / 30


@register("variogram_bins", f"""WITH {CTE_ROWS}, c AS (SELECT ym, floor(x / {_CELL}) AS cx, floor(y / {_CELL}) AS cy, u.variable AS variable, u.value AS v, row_id
   FROM (SELECT *, unnest({stacked(COORDS)}) AS u FROM rows_)),
 pairs AS (SELECT a.variable, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS h, (a.v - b.v) * (a.v - b.v) AS d2
   FROM c a JOIN c b ON a.variable = b.variable AND a.ym = b.ym AND a.row_id < b.row_id)
SELECT variable, CAST(floor(h / 2) AS INTEGER) AS bin, count(*) AS pairs, round(avg(h) * {_CELL}, 6) AS distance, round(avg(d2) / 2, 6) AS gamma
FROM pairs WHERE h < 30 GROUP BY ALL""")
def variogram_bins(spark, sf):
    return rounded(M.variogram(station_rows(spark, sf), COORDS, "x", "y", ["ym"], MAX_DIST), ["distance", "gamma"])


@register("month_memory", f"""WITH {CTE_ROWS} SELECT u.variable AS variable, count(*) AS pairs, round(corr(u.now, u.before), 6) AS rho FROM (
  SELECT unnest([{', '.join(f"{{'variable': '{c}', 'now': b.{c}, 'before': a.{c}}}" for c in COORDS)}]) AS u
  FROM rows_ a JOIN rows_ b ON a.station = b.station AND b.ym = a.ym + 1) GROUP BY ALL""")
def month_memory(spark, sf):
    return rounded(M.ar1(station_rows(spark, sf), COORDS, "station"), ["rho"])


@register("field_model", None)
def field_model(spark, sf):
    """Range, kappa, variance, nugget and memory of the residual field of each response."""
    model = M.fit_surface(cut(station_rows(spark, sf), "stations"), COORDS, XS, "county", "station", "row_id", MAX_DIST)
    out = None
    for y, m in model.fields.items():
        t = m.table(spark).withColumn("response", F.lit(y))
        out = t if out is None else out.unionByName(t)
    return out


def surface(spark, sf):
    rows = cut(station_rows(spark, sf), "stations")
    model = M.fit_surface(rows, COORDS, XS, "county", "station", "row_id", MAX_DIST)
    county = stations(spark, sf).select(F.col("station").alias("code"), "county")
    targets = lattice_frame(spark, sf).join(county, "code").dropna(subset=XS)
    targets = cut(targets.withColumn("target", F.col("cell") * 100000 + F.col("ym")), "targets")
    return M.predict_surface(model, targets, "target", "row_id")


@register("exposure_surface", None)
def exposure_surface(spark, sf):
    """Six responses on the lattice-months: mean and band."""
    return surface(spark, sf).select("cell", "x", "y", "ym", *[f"{a}_{y}" for y in COORDS for a in ("mean", "ll", "ul")])


@register("surface_displays", None)
def surface_displays(spark, sf):
    """The fitted surface of all six responses as a stored long table, its June and December slices read back, each response on
    the scale of its own extent."""
    pred = surface(spark, sf)
    path = f"{scratch_root(spark)}/surface-{uuid.uuid4().hex}"
    M.store_predictions(M.long_surface(pred, COORDS, 1995 * 12 + 1, "1995-01-01", ["cell", "x", "y"]), path)
    slices = M.month_slice(M.stored_predictions(spark, path), [6, 12])
    out = M.clamp_display(slices, by=["response"])
    return out.select("cell", "x", "y", "ym", "date", "year", "response", "statistic", "facet", "value", "shown", "position")


@register("holdout_scores", None)
def holdout_scores(spark, sf):
    return M.holdout(cut(station_rows(spark, sf), "stations"), COORDS, XS, "county", "station", "row_id", MAX_DIST)


CTE_PRED = f"""{CTE_ROWS}, pred AS (SELECT x, y, ym, B1 AS pred_mean, B1 - 1.959964 * 2 AS pred_ll, B1 + 1.959964 * 2 AS pred_ul FROM rows_),
 lng AS (SELECT x, y, ym, unnest([{{'variable': 'pred_mean', 'value': pred_mean}}, {{'variable': 'pred_ll', 'value': pred_ll}}, {{'variable': 'pred_ul', 'value': pred_ul}}]) AS u,
    CAST(DATE '2020-01-01' + to_months(CAST(ym - (SELECT min(ym) FROM rows_) AS INTEGER)) AS DATE) AS date FROM pred)"""


def _long(spark, sf):
    """Long prediction table in which the observed coordinate plays the mean and 2 the sd."""
    rows = cut(station_rows(spark, sf), "stations")
    base = rows.agg(F.min("ym")).first()[0]
    return M.long_predictions(M.bands(rows, F.col("B1"), F.lit(4.0)), base)


@register("long_predictions", f"WITH {CTE_PRED} SELECT x, y, ym, u.variable AS statistic, round(u.value, 6) AS value, date FROM lng")
def long_predictions(spark, sf):
    return rounded(_long(spark, sf), ["value"])


@register("stored_predictions", f"""WITH {CTE_PRED} SELECT x, y, ym, u.variable AS statistic, round(u.value + CASE year(date) WHEN 2021 THEN 1 ELSE 0 END, 6) AS value, date,
  CAST(year(date) AS INTEGER) AS year FROM lng WHERE u.variable = 'pred_mean'""")
def stored_predictions(spark, sf):
    """The table written by statistic and year, one year run again with other values, and one statistic read back."""
    path = f"{scratch_root(spark)}/predictions-{uuid.uuid4().hex}"
    long = cut(_long(spark, sf), "long")
    M.store_predictions(long, path)
    M.store_predictions(long.filter(F.year("date") == 2021).withColumn("value", F.col("value") + 1), path)
    return rounded(M.stored_predictions(spark, path, "pred_mean").select("x", "y", "ym", "statistic", "value", "date", "year"), ["value"])


@register("month_slices", f"""WITH {CTE_PRED} SELECT x, y, ym, u.variable AS statistic, round(u.value, 6) AS value, date, CAST(year(date) AS INTEGER) AS year,
  CASE u.variable WHEN 'pred_mean' THEN 1 WHEN 'pred_ll' THEN 2 ELSE 3 END AS facet FROM lng WHERE month(date) IN (2, 9)""")
def month_slices(spark, sf):
    return rounded(M.month_slice(_long(spark, sf), [2, 9]), ["value"])


@register("clamped_display", f"""WITH {CTE_PRED} SELECT x, y, ym, u.variable AS statistic, {r6_sql('u.value AS value', 'least(greatest(u.value, -1), 1) AS shown',
  '(least(greatest(u.value, -1), 1) + 1) / 2 AS position')}, date FROM lng""")
def clamped_display(spark, sf):
    return rounded(M.clamp_display(_long(spark, sf), (-1.0, 1.0)), ["value", "shown", "position"])


@register("fit_statistics", f"""WITH {CTE_ROWS} SELECT count(*) AS n, round(avg(-0.5 * ln(2 * pi() * 4) - (B1 - B2) * (B1 - B2) / 8), 6) AS log_score,
  round(count(*) * (ln(2 * pi() * sum((B1 - B2) * (B1 - B2)) / count(*)) + 1) + 2 * 5, 6) AS aic FROM rows_""")
def fit_statistics(spark, sf):
    rows = station_rows(spark, sf).withColumn("sd", F.lit(2.0))
    return rounded(M.fit_statistics(rows, "B1", "B2", "sd", 4), ["log_score", "aic"])
