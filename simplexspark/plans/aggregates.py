"""Aggregations, summaries, windows, ordering, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from simplexspark.functions.scalars import category_rank, month_index
from simplexspark.functions.simplex import clr, total
from simplexspark.operators import ranking, reshape, stats
from simplexspark.plans.base import (
    AREAS, COORDS, CTE_COMPLETE, CTE_KEPT, CTE_PANEL, CTE_SITES, CTE_STATIONS, CTE_TSPACE, KEY, PARTS, Query, TYPES,
    complete, kept, panel, r6, r6_sql, readings, rounded, sites, stacked, stations, table, tspace,
)

QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f
    return keep


CTE_LONG = f"long AS (SELECT station, year, month, unnest({stacked(COORDS)}) AS u FROM tspace)"


@register("monthly_coordinates", f"""WITH {CTE_TSPACE}, {CTE_LONG}
SELECT year, month, u.variable AS variable, round(avg(u.value), 6) AS value FROM long GROUP BY ALL""")
def monthly_coordinates(spark, sf):
    """Flagship: readings -> monthly six-part panel -> complete rows -> balances and total ->
    mean by variable, year and month."""
    return rounded(stats.mean_by(tspace(spark, sf), ["year", "month"], COORDS), ["value"])


@register("duplicate_keys", """
SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n
FROM orders GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return reshape.duplicate_keys(o, ["o_custkey", "year", "month"])


@register("distinct_counts", """
SELECT count(DISTINCT l_suppkey) AS stations, count(DISTINCT l_partkey) AS parts, count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem""")
def distinct_counts(spark, sf):
    li = table(spark, sf, "lineitem")
    counts = stats.distinct_counts(li, ["l_suppkey", "l_partkey"]).toDF("stations", "parts")
    return counts.withColumns({"n_rows": F.lit(li.count()), "n_cols": F.lit(len(li.columns)).cast("long")})


@register("sketched_counts", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(DISTINCT l_suppkey) AS stations, count(DISTINCT l_partkey) AS parts, TRUE AS stations_near, TRUE AS parts_near
FROM lineitem GROUP BY ALL""")
def sketched_counts(spark, sf):
    """Distinct stations and parts a year from stored monthly sketches, held against the exact counts (five standard errors)."""
    from simplexspark.sources import cut

    li = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
                                             F.col("l_suppkey").alias("stations"), F.col("l_partkey").alias("parts"))
    monthly = cut(stats.distinct_sketches(li, ["year", "month"], ["stations", "parts"]), "sketches")
    about = stats.merged_counts(monthly, ["year"], ["stations", "parts"]).toDF("y", "s", "p")
    exact = li.groupBy("year").agg(F.count_distinct("stations").alias("stations"), F.count_distinct("parts").alias("parts"))
    near = lambda a, n: F.abs(F.col(a) - F.col(n)) <= 5 / 64 * F.col(n)
    return exact.join(about, F.col("year") == F.col("y")).select("year", "stations", "parts", near("s", "stations").alias("stations_near"), near("p", "parts").alias("parts_near"))


@register("distinct_rows", f"WITH {CTE_STATIONS} SELECT DISTINCT county, area FROM stations")
def distinct_rows(spark, sf):
    return stations(spark, sf).select("county", "area").distinct()


@register("distinct_on_keys", """
SELECT l_suppkey AS station, CAST(year(l_shipdate) AS INTEGER) AS year, arg_min(l_quantity, ROW(l_orderkey * 10 + l_linenumber, l_quantity)) AS quantity
FROM lineitem GROUP BY ALL""")
def distinct_on_keys(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("station"), F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("quantity"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return reshape.distinct_on(li, ["station", "year"], ["line"]).drop("line")


@register("column_profile", f"""WITH {CTE_KEPT}, long AS (SELECT unnest({stacked(PARTS)}) AS u FROM kept)
SELECT u.variable AS variable, count(u.value) AS n, count(*) - count(u.value) AS n_missing,
  round(100 * avg(CASE WHEN u.value IS NULL THEN 1e0 ELSE 0 END), 6) AS pct_missing, round(avg(u.value), 6) AS mean,
  round(median(u.value), 6) AS median, round(stddev_samp(u.value), 6) AS sd, round(min(u.value), 6) AS min, round(max(u.value), 6) AS max
FROM long GROUP BY ALL""")
def column_profile(spark, sf):
    return rounded(stats.profile(kept(spark, sf), PARTS), ["pct_missing", "mean", "median", "sd", "min", "max"])


@register("coordinate_summary", f"""WITH {CTE_TSPACE}, {CTE_LONG}
SELECT u.variable AS variable, {r6_sql('min(u.value) AS min', 'quantile_cont(u.value, 0.25) AS q1', 'median(u.value) AS median',
  'avg(u.value) AS mean', 'quantile_cont(u.value, 0.75) AS q3', 'max(u.value) AS max', 'stddev_samp(u.value) AS sd')}
FROM long GROUP BY ALL""")
def coordinate_summary(spark, sf):
    return rounded(stats.summary_table(tspace(spark, sf), COORDS), ["min", "q1", "median", "mean", "q3", "max", "sd"])


@register("refined_quantiles", """
SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(median(l_extendedprice), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem GROUP BY ALL""")
def refined_quantiles(spark, sf):
    """Exact quantiles with narrow brackets on groups far larger than the summaries."""
    from simplexspark.operators.quantiles import exact_quantiles

    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    out = exact_quantiles(li, ["flag"], "l_extendedprice", [0.25, 0.5, 0.75], ["q1", "median", "q3"], accuracy=1000)
    return rounded(out, ["q1", "median", "q3"])


@register("contingency_counts", f"WITH {CTE_STATIONS} SELECT station_type, area, count(*) AS n FROM stations GROUP BY ALL")
def contingency_counts(spark, sf):
    return stats.contingency(stations(spark, sf), "station_type", "area")


@register("contingency_table", f"""WITH {CTE_PANEL}, {CTE_STATIONS} SELECT station_type, count(*) FILTER (WHERE area = 'urban') AS urban,
  count(*) FILTER (WHERE area = 'suburban') AS suburban, count(*) FILTER (WHERE area = 'rural') AS rural
FROM panel JOIN stations USING (station) GROUP BY ALL""")
def contingency_table(spark, sf):
    rows = panel(spark, sf).select("station").join(stations(spark, sf), "station")
    return stats.contingency(rows, "station_type", "area", AREAS)


@register("extent_of_points", f"WITH {CTE_SITES} SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM sites")
def extent_of_points(spark, sf):
    return stats.extent(sites(spark, sf), ["x", "y"])


@register("collapsed_duplicates", """
SELECT o_custkey AS code, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS ym, round(avg(o_totalprice), 6) AS load
FROM orders GROUP BY ALL""")
def collapsed_duplicates(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("code"),
                                          month_index(F.year("o_orderdate"), F.month("o_orderdate")).alias("ym"),
                                          F.col("o_totalprice").alias("load"))
    return rounded(reshape.mean_duplicates(o, ["code", "ym"], ["load"]), ["load"])


@register("observed_part_counts", f"""WITH {CTE_PANEL} SELECT station, year, month,
  {' + '.join(f'({p} IS NOT NULL)::INTEGER' for p in PARTS)} AS n_observed FROM panel""")
def observed_part_counts(spark, sf):
    return stats.n_observed(panel(spark, sf), PARTS).select(*KEY, "n_observed")


_BOX = """SELECT {by}, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)), 6) AS lower,
  round(max(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)), 6) AS upper,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM cells JOIN (SELECT {by}, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3
  FROM cells GROUP BY ALL) USING ({by}) GROUP BY ALL"""
BOX_COLS = ["q1", "median", "q3", "lower", "upper"]


@register("box_statistics", f"""WITH {CTE_PANEL}, cells AS (SELECT u.variable AS part, u.value AS value FROM
  (SELECT unnest({stacked(PARTS)}) AS u FROM panel) WHERE u.value IS NOT NULL) {_BOX.format(by='part')}""")
def box_statistics(spark, sf):
    long = reshape.unpivot(panel(spark, sf).select(*PARTS), [], PARTS, "part")
    return rounded(stats.box_stats(long, ["part"], "value"), BOX_COLS)


@register("box_statistics_strata", f"""WITH {CTE_PANEL}, {CTE_STATIONS}, cells AS (SELECT station_type, area, u.variable AS part, u.value AS value FROM
  (SELECT station_type, area, unnest({stacked(PARTS)}) AS u FROM panel JOIN stations USING (station))
  WHERE u.value IS NOT NULL AND u.variable IN ('p_nf', 'p_no')) {_BOX.format(by='station_type, area, part')}""")
def box_statistics_strata(spark, sf):
    rows = panel(spark, sf).join(stations(spark, sf).select("station", "station_type", "area"), "station")
    long = reshape.unpivot(rows, ["station_type", "area"], ["p_nf", "p_no"], "part")
    return rounded(stats.box_stats(long, ["station_type", "area", "part"], "value"), BOX_COLS)


@register("fill_agreement", f"""WITH {CTE_COMPLETE}, cells AS (
  SELECT unnest([{', '.join(f"{{'a': {p}, 'b': (p_af + p_ao + p_nf + p_no + p_rf + p_ro) / 6}}" for p in PARTS)}]) AS c FROM complete)
SELECT round(corr(c.a, c.b), 6) AS r, round(sqrt(avg((c.a - c.b) * (c.a - c.b))), 6) AS rmse, count(*) AS n FROM cells""")
def fill_agreement(spark, sf):
    """Agreement of two fills of a panel; the second is every row's mean."""
    rows = complete(spark, sf)
    mean = sum([F.col(p) for p in PARTS[1:]], F.col(PARTS[0])) / 6
    rows = rows.select(*PARTS, *[mean.alias(f"m_{p}") for p in PARTS])
    return rounded(stats.concordance(rows, [(p, f"m_{p}") for p in PARTS]), ["r", "rmse"])


@register("holdout_metrics", f"""WITH {CTE_PANEL} SELECT CAST(count(*) AS BIGINT) AS n, round(corr(p_af, p_ao), 6) AS r,
  round(sqrt(avg((p_ao - p_af) * (p_ao - p_af))), 6) AS rmse, round(avg(abs(p_ao - p_af)), 6) AS mae
FROM panel WHERE p_af IS NOT NULL AND p_ao IS NOT NULL""")
def holdout_metrics(spark, sf):
    return rounded(stats.score(panel(spark, sf), "p_af", "p_ao"), ["r", "rmse", "mae"])


@register("cell_provenance", f"""WITH {CTE_KEPT}, long AS (SELECT station, year, month, unnest({stacked(PARTS)}) AS u FROM kept)
SELECT station, year, month, u.variable AS part, CASE WHEN u.value IS NULL THEN 'Imputed' ELSE 'Original' END AS origin FROM long""")
def cell_provenance(spark, sf):
    return stats.flag_imputed(kept(spark, sf), KEY, PARTS)


# --- outlier tables on a fixed rule (the fitted screen is in plans.composition) ----------

CTE_FLAGGED = f"""{CTE_PANEL}, {CTE_STATIONS}, flagged AS (
  SELECT p.*, s.station_type, s.area, s.x, s.y, {' + '.join(f'({p} IS NOT NULL)::INTEGER' for p in PARTS)} AS n_observed,
    CASE WHEN coalesce(p_af, 0) > 60000 OR coalesce(p_ro, 0) > 60000 THEN 'Outlier' ELSE 'No outlier' END AS outlier
  FROM panel p JOIN stations s USING (station))"""


def flagged(spark, sf):
    high = (F.coalesce("p_af", F.lit(0)) > 60000) | (F.coalesce("p_ro", F.lit(0)) > 60000)
    rows = stats.n_observed(panel(spark, sf), PARTS).withColumn("outlier", F.when(high, "Outlier").otherwise("No outlier"))
    return rows.withColumn("outlier_bin", (F.col("outlier") == "Outlier").cast("int")).join(stations(spark, sf).drop("altitude"), "station")


@register("outlier_shares", f"""WITH {CTE_FLAGGED}, counts AS (SELECT area, station_type, outlier, count(*) AS n FROM flagged GROUP BY ALL)
SELECT area, station_type, outlier, n, round(n / CAST(sum(n) OVER (PARTITION BY area, station_type) AS DOUBLE), 6) AS prop,
  CASE area WHEN 'urban' THEN 1 WHEN 'suburban' THEN 2 ELSE 3 END AS area_rank FROM counts""")
def outlier_shares(spark, sf):
    out = stats.shares(flagged(spark, sf), ["area", "station_type"], "outlier")
    return rounded(out, ["prop"]).withColumn("area_rank", category_rank("area", AREAS))


@register("outliers_by_observed", f"""WITH {CTE_FLAGGED}
SELECT n_observed, station_type, area, count(*) AS n FROM flagged WHERE outlier = 'Outlier' GROUP BY ALL""")
def outliers_by_observed(spark, sf):
    rows = flagged(spark, sf).filter(F.col("outlier") == "Outlier")
    return rows.groupBy("n_observed", "station_type", "area").agg(F.count(F.lit(1)).alias("n"))


@register("weak_outliers_dropped", f"""WITH {CTE_FLAGGED}
SELECT station, year, month, outlier, n_observed FROM flagged WHERE NOT (n_observed <= 3 AND outlier = 'Outlier')""")
def weak_outliers_dropped(spark, sf):
    from simplexspark.operators.robust import drop_weak_outliers

    return drop_weak_outliers(flagged(spark, sf), 3).select(*KEY, "outlier", "n_observed")


@register("outlier_rates", f"""WITH {CTE_FLAGGED}
SELECT station, x, y, station_type, area, round(100 * avg(CASE WHEN outlier = 'Outlier' THEN 1e0 ELSE 0 END), 6) AS pct_outliers
FROM flagged GROUP BY ALL""")
def outlier_rates(spark, sf):
    return rounded(stats.rate(flagged(spark, sf), ["station", "x", "y", "station_type", "area"], "outlier_bin", "pct_outliers"),
                   ["pct_outliers"])


# --- windows, ordering, sampling --------------------------------------------------------


@register("row_ids", f"""WITH {CTE_PANEL} SELECT station, year, month, row_number() OVER (ORDER BY station, year, month) AS row_id FROM panel""")
def row_ids(spark, sf):
    return ranking.add_row_id(panel(spark, sf).select(*KEY), KEY)


@register("month_groups", f"""WITH {CTE_PANEL} SELECT station, year, month, CAST(year * 12 + month AS INTEGER) AS ym,
  CAST(year * 12 + month - (SELECT min(year * 12 + month) FROM panel) + 1 AS INTEGER) AS month_group FROM panel""")
def month_groups(spark, sf):
    rows = panel(spark, sf).select(*KEY, month_index("year", "month").alias("ym"))
    base = readings(spark, sf).agg(F.min(month_index("year", "month"))).first()[0]
    return rows.withColumn("month_group", F.col("ym") - base + 1)


@register("sorted_panel", f"WITH {CTE_PANEL} SELECT station, year, month, count(*) AS n FROM panel GROUP BY ALL ORDER BY n DESC, station, year, month")
def sorted_panel(spark, sf):
    return panel(spark, sf).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *KEY)


_SPLIT = """WITH h AS (SELECT o_orderkey, o_totalprice, md5(CAST(o_orderkey AS VARCHAR) || '|1714') AS h FROM orders),
  r AS (SELECT *, row_number() OVER (ORDER BY h) AS i, count(*) OVER () AS n FROM h)
SELECT o_orderkey, i <= floor(0.75 * n) AS train, CASE WHEN i <= floor(0.75 * n) THEN o_totalprice END AS y FROM r"""


@register("exact_split", _SPLIT)
def exact_split(spark, sf):
    """Three quarters drawn exactly; the response is masked on the rest."""
    train, test = ranking.split_exact(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 0.75, 1714, ["o_orderkey"])
    a = train.select("o_orderkey", F.lit(True).alias("train"), F.col("o_totalprice").alias("y"))
    b = test.select("o_orderkey", F.lit(False).alias("train"), F.lit(None).cast("double").alias("y"))
    return a.unionByName(b)


CTE_SERIES = f"""{CTE_TSPACE}, {CTE_LONG}, series AS (SELECT u.variable AS variable, u.value AS v,
    row_number() OVER (PARTITION BY u.variable ORDER BY station, year, month) AS i,
    avg(u.value) OVER (PARTITION BY u.variable) AS m, count(*) OVER (PARTITION BY u.variable) AS n FROM long)"""
CTE_ACF = f"""{CTE_SERIES}, acf AS (SELECT a.variable, a.n, l.lag, sum((a.v - a.m) * (b.v - b.m)) / any_value(t.c0) AS acf
  FROM series a CROSS JOIN range(0, 24) l(lag) JOIN series b ON b.variable = a.variable AND b.i = a.i + l.lag
  JOIN (SELECT variable, sum((v - m) * (v - m)) AS c0 FROM series GROUP BY ALL) t ON t.variable = a.variable
  GROUP BY a.variable, a.n, l.lag)"""


def coordinate_acf(spark, sf, by=()):
    long = reshape.unpivot(tspace(spark, sf), KEY, COORDS)
    return ranking.acf(long, "value", [k for k in KEY if k not in by], 23, ["variable", *by])


@register("autocorrelation", f"""WITH {CTE_ACF} SELECT variable, n, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf FROM acf""")
def autocorrelation(spark, sf):
    """Six coordinates in stacked row order, lags across station boundaries included."""
    return rounded(coordinate_acf(spark, sf), ["acf"])


@register("partial_autocorrelation", f"""WITH RECURSIVE {CTE_ACF},
  rr AS (SELECT variable, n, list(acf ORDER BY lag)[2:] AS r FROM acf GROUP BY ALL),
  dl AS (
    SELECT variable, n, r, 1 AS k, [r[1]] AS phi, 1 - r[1] * r[1] AS v, r[1] AS ref FROM rr
    UNION ALL
    SELECT variable, n, r, k + 1, list_append(list_transform(phi, lambda p, j: p - q * phi[k + 1 - j]), q), v * (1 - q * q), q
    FROM (SELECT *, (r[k + 1] - list_sum(list_transform(phi, lambda p, j: p * r[k + 1 - j]))) / v AS q FROM dl WHERE k < 23))
SELECT variable, n, k AS lag, round(ref, 6) AS pacf, round(1 / sqrt(n), 6) AS band FROM dl""")
def partial_autocorrelation(spark, sf):
    return rounded(ranking.pacf(coordinate_acf(spark, sf), ["variable"]), ["pacf", "band"])


CTE_SACF = f"""{CTE_TSPACE}, {CTE_LONG}, series AS (SELECT station, u.variable AS variable, u.value AS v,
    row_number() OVER (PARTITION BY u.variable, station ORDER BY year, month) AS i,
    avg(u.value) OVER (PARTITION BY u.variable, station) AS m, count(*) OVER (PARTITION BY u.variable, station) AS n FROM long)"""


@register("autocorrelation_by_station", f"""WITH {CTE_SACF}
SELECT a.variable, a.station, a.n, CAST(l.lag AS INTEGER) AS lag, round(coalesce(sum((a.v - a.m) * (b.v - b.m)) / nullif(any_value(t.c0), 0), 0), 6) AS acf
FROM series a CROSS JOIN range(0, 24) l(lag) JOIN series b ON b.variable = a.variable AND b.station = a.station AND b.i = a.i + l.lag
JOIN (SELECT variable, station, sum((v - m) * (v - m)) AS c0 FROM series GROUP BY ALL) t ON t.variable = a.variable AND t.station = a.station
GROUP BY a.variable, a.station, a.n, l.lag""")
def autocorrelation_by_station(spark, sf):
    """Six coordinates, 23 lags, inside each station only."""
    return rounded(coordinate_acf(spark, sf, ["station"]), ["acf"])
