"""Sources, projections, filters, scalar functions, reshaping and key joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simplexspark.functions import scalars as S
from simplexspark.operators import joins, reshape
from simplexspark.plans.base import (
    AREAS, CTE_KEPT, CTE_PANEL, CTE_SITES, CTE_STATIONS, KEY, PARTS, Query, TYPES, kept, panel, r6, r6_sql, readings,
    rounded, sites, stacked, stations, table,
)
from simplexspark.sources import load_stage, materialise, read_polygons, read_raster, read_table, save_stage, scratch_root

QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f
    return keep


def _path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


# --- sources and sinks ------------------------------------------------------------------


@register("delimited_source", """
SELECT o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price FROM orders GROUP BY ALL""")
def delimited_source(spark, sf):
    path = _path(spark, "orders-csv")
    table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("order_key", T.LongType()), T.StructField("priority", T.StringType()),
                           T.StructField("price", T.DoubleType())])
    return read_table(spark, path, schema).groupBy("priority").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("price")).alias("mean_price"))


@register("saved_stage", f"WITH {CTE_PANEL} SELECT year, count(*) AS n, {r6_sql('avg(p_af) AS mean_af')} FROM panel GROUP BY ALL")
def saved_stage(spark, sf):
    path = _path(spark, "panel")
    save_stage(panel(spark, sf), path, ["year"])
    return load_stage(spark, path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p_af")).alias("mean_af"))


@register("compute_once", f"WITH {CTE_PANEL} SELECT month, count(p_ro) AS n_ro FROM panel GROUP BY ALL")
def compute_once(spark, sf):
    path = _path(spark, "once")
    build = lambda: panel(spark, sf).groupBy("month").agg(F.count("p_ro").alias("n_ro"))
    materialise(spark, path, build)
    return materialise(spark, path, lambda: build().filter(F.lit(False)))


OUTLINE_SQL = """outline AS (
  SELECT r_name AS region, 0 AS ring, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS INTEGER) AS seq,
    5000 + (2500 + (n_nationkey * 1371) % 2400) * cos(1.2566370614359172 * (n_nationkey // 5) + 0.3 * n_regionkey) AS lon,
    5000 + (2500 + (n_nationkey * 1371) % 2400) * sin(1.2566370614359172 * (n_nationkey // 5) + 0.3 * n_regionkey) AS lat
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def outlines(spark, sf) -> DataFrame:
    """A five-cornered outline per region, one corner per nation. A region's nations are few,
    so numbering them in a window is bounded by the region."""
    from pyspark.sql import Window

    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    radius = 2500 + (F.col("n_nationkey") * 1371) % 2400
    angle = F.floor(F.col("n_nationkey") / 5) * F.lit(1.2566370614359172) + F.col("n_regionkey") * F.lit(0.3)
    seq = F.row_number().over(Window.partitionBy("r_regionkey").orderBy("n_nationkey"))
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("region"), F.lit(0).alias("ring"), seq.alias("seq"),
        (radius * F.cos(angle) + 5000).alias("lon"), (radius * F.sin(angle) + 5000).alias("lat"))


@register("region_outlines", f"""WITH {OUTLINE_SQL} SELECT region, ring, seq, {r6_sql('lon', 'lat')} FROM outline
WHERE region IN (SELECT r_name FROM region WHERE r_regionkey IN (1, 3))""")
def region_outlines(spark, sf):
    path = _path(spark, "outline")
    save_stage(outlines(spark, sf), path)
    names = [r[0] for r in table(spark, sf, "region").filter("r_regionkey IN (1, 3)").select("r_name").collect()]
    return rounded(read_polygons(spark, path, names), ["lon", "lat"])


RASTER_SQL = """raster AS (
  SELECT CAST(p_partkey % 97 AS BIGINT) AS cell_x, CAST((p_partkey * 31) % 89 AS BIGINT) AS cell_y,
    avg(CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice - 950 END) AS value FROM part GROUP BY ALL)"""


def raster(spark, sf) -> DataFrame:
    """Cells of an elevation-like grid, with negative and missing values."""
    k = F.col("p_partkey")
    value = F.when(k % 11 != 0, F.col("p_retailprice") - 950)
    return (table(spark, sf, "part").groupBy((k % 97).alias("cell_x"), ((k * 31) % 89).alias("cell_y"))
            .agg(F.avg(value).alias("value")))


@register("raster_cells", f"WITH {RASTER_SQL} SELECT cell_x, cell_y, round(value, 6) AS value FROM raster")
def raster_cells(spark, sf):
    path = _path(spark, "raster")
    save_stage(raster(spark, sf), path)
    return rounded(read_raster(spark, path), ["value"])


# --- projections, filters, predicates ---------------------------------------------------


@register("column_selection", """SELECT s_suppkey AS code, s_acctbal AS balance, s_name AS name FROM supplier""")
def column_selection(spark, sf):
    s = table(spark, sf, "supplier")
    s = s.drop("s_nationkey").withColumnsRenamed({"s_suppkey": "code", "s_name": "name", "s_acctbal": "balance"})
    return reshape.relocate(s, ["balance"], "code")


@register("columns_by_type", """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem""")
def columns_by_type(spark, sf):
    li = table(spark, sf, "lineitem")
    numeric = [c for c in reshape.columns_of_type(li) if c in set(reshape.columns_with_prefix(li, "l_"))]
    drop = {"l_partkey", "l_suppkey", "l_extendedprice", "l_tax"}
    return li.select(*[c for c in numeric if c not in drop])


@register("positional_names", "SELECT n_nationkey AS a, n_name AS b, n_regionkey AS c FROM nation")
def positional_names(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").toDF("a", "b", "c")


@register("computed_columns", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
  CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS ym,
  round(o_totalprice * 1000, 3) AS scaled, 'KNN' AS method FROM orders""")
def computed_columns(spark, sf):
    o = table(spark, sf, "orders").withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})
    return o.select("o_orderkey", "year", "month", S.month_index("year", "month").alias("ym"),
                    F.round(F.col("o_totalprice") * 1000, 3).alias("scaled"), F.lit("KNN").alias("method"))


@register("membership_filter", """
SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS part FROM lineitem
WHERE l_returnflag || l_linestatus IN ('AF', 'NO')""")
def membership_filter(spark, sf):
    li = table(spark, sf, "lineitem")
    part = F.concat("l_returnflag", "l_linestatus")
    return li.filter(part.isin("AF", "NO")).select("l_orderkey", "l_linenumber", part.alias("part"))


@register("compound_filter", f"""WITH {CTE_PANEL} SELECT station, year, month FROM panel
WHERE NOT (station % 7 = 1 AND year IN (1997, 1998) AND p_af > 30000)""")
def compound_filter(spark, sf):
    hit = (F.col("station") % 7 == 1) & F.col("year").isin(1997, 1998) & (F.col("p_af") > 30000)
    return panel(spark, sf).filter(~hit).select(*KEY)


@register("min_observed_parts", f"WITH {CTE_KEPT} SELECT station, year, month, {r6_sql(*PARTS)} FROM kept")
def min_observed_parts(spark, sf):
    return rounded(kept(spark, sf), PARTS)


@register("month_filter", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders
WHERE month(o_orderdate) = 2 AND year(o_orderdate) = 1997""")
def month_filter(spark, sf):
    d = F.col("o_orderdate")
    return (table(spark, sf, "orders").filter((F.month(d) == 2) & (F.year(d) == 1997))
            .select("o_orderkey", d.cast("date").alias("date")))


@register("ordered_category", f"""WITH {CTE_STATIONS} SELECT station, area,
  CASE area WHEN 'urban' THEN 1 WHEN 'suburban' THEN 2 WHEN 'rural' THEN 3 END AS area_rank FROM stations""")
def ordered_category(spark, sf):
    return stations(spark, sf).select("station", "area", S.category_rank("area", AREAS).alias("area_rank"))


@register("combined_category", f"""WITH {CTE_STATIONS} SELECT upper(station_type[1]) || station_type[2:] || '-' ||
  upper(area[1]) || area[2:] AS category, count(*) AS n FROM stations GROUP BY ALL""")
def combined_category(spark, sf):
    return (stations(spark, sf).groupBy(S.interaction("station_type", "area").alias("category"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("recode_values", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS status,
  CASE o_custkey % 4 WHEN 1 THEN 'urban' WHEN 2 THEN 'suburban' WHEN 3 THEN 'rural' END AS area,
  CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS big FROM orders""")
def recode_values(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", S.recode("o_orderstatus", {"F": "Filled", "O": "Open"}).alias("status"),
        S.lookup(F.col("o_custkey") % 4, S.URBAN_CODES).alias("area"),
        F.when(F.col("o_totalprice") > 100000, 1).otherwise(0).alias("big"))


# --- scalar functions -------------------------------------------------------------------


@register("date_parsing", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '31/02/1997' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS txt
  FROM orders)
SELECT o_orderkey, CAST(try_strptime(txt, '%d/%m/%Y') AS DATE) AS date,
  CAST(year(try_strptime(txt, '%d/%m/%Y')) AS INTEGER) AS year, CAST(month(try_strptime(txt, '%d/%m/%Y')) AS INTEGER) AS month,
  CAST(try_strptime(txt, '%d/%m/%Y') + INTERVAL 1 MONTH AS DATE) AS next_month FROM t""")
def date_parsing(spark, sf):
    txt = F.when(F.col("o_orderkey") % 13 == 0, F.lit("31/02/1997")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    o = table(spark, sf, "orders").select("o_orderkey", S.dmy_date(txt).alias("date"))
    return o.withColumns({"year": F.year("date"), "month": F.month("date"), "next_month": S.add_months("date", 1)})


@register("coordinate_repair", """
WITH t AS (SELECT c_custkey, replace(printf('%.4f', (c_custkey * 7919 % 10007) / 3e3), '.', ',') AS lon,
    CASE WHEN c_custkey % 3 = 0 THEN '41.' || CAST(c_custkey % 1000 AS VARCHAR) WHEN c_custkey % 7 = 0 THEN 'n/a'
      ELSE '41' || CAST(c_custkey % 1000 AS VARCHAR) END AS lat FROM customer)
SELECT c_custkey, TRY_CAST(replace(lon, ',', '.') AS DOUBLE) AS longitude,
  TRY_CAST(regexp_replace(lat, '^([0-9]{2})([0-9]+)$', '\\1.\\2') AS DOUBLE) AS latitude FROM t""")
def coordinate_repair(spark, sf):
    k = F.col("c_custkey")
    lon = F.replace(F.format_string("%.4f", (k * 7919 % 10007) / F.lit(3e3)), F.lit("."), F.lit(","))
    tail = (k % 1000).cast("string")
    lat = (F.when(k % 3 == 0, F.concat(F.lit("41."), tail)).when(k % 7 == 0, "n/a").otherwise(F.concat(F.lit("41"), tail)))
    return table(spark, sf, "customer").select("c_custkey", S.comma_number(lon).alias("longitude"),
                                               S.restore_point(lat).alias("latitude"))


@register("season_of_month", """
SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Hivern' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Primavera'
  WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Estiu' ELSE 'Tardor' END AS season,
  CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 1 WHEN month(o_orderdate) IN (3, 4, 5) THEN 2
  WHEN month(o_orderdate) IN (6, 7, 8) THEN 3 ELSE 4 END AS season_rank FROM orders""")
def season_of_month(spark, sf):
    s = S.season(F.month("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", s.alias("season"),
                                             S.category_rank(s, list(S.SEASONS)).alias("season_rank"))


@register("number_functions", """
SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) AS log_price, round(sqrt(l_quantity), 6) AS root,
  abs(l_quantity - 25) AS away, round(pow(l_discount, 2), 6) AS disc2, CAST(floor(l_extendedprice / 7) AS BIGINT) AS whole,
  CASE WHEN l_quantity - 25 < 0 THEN 0 ELSE l_quantity - 25 END AS floored, printf('%.2f', l_tax) AS tax_text,
  least(greatest(l_quantity, 10), 40) AS clamped, round((least(greatest(l_quantity, 10), 40) - 10) / 30, 6) AS position,
  10 + (l_linenumber - 1) * (90e0 / 6) AS spaced FROM lineitem""")
def number_functions(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(F.ln("l_extendedprice")).alias("log_price"), r6(F.sqrt(q)).alias("root"),
        F.abs(q - 25).alias("away"), r6(F.pow("l_discount", F.lit(2))).alias("disc2"),
        F.floor(F.col("l_extendedprice") / 7).alias("whole"), S.floor_at_zero(q - 25).alias("floored"),
        S.fixed_text("l_tax", 2).alias("tax_text"), S.clamp(q, 10, 40).alias("clamped"),
        r6(S.scale_position(q, 10, 40)).alias("position"), S.spaced(F.col("l_linenumber") - 1, 10, 100, 7).alias("spaced"))


@register("decoded_bits", """
WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'ok' ELSE
    CAST((l_quantity > 45)::INTEGER AS VARCHAR) || CAST((l_discount > 0.07)::INTEGER AS VARCHAR) || CAST((l_tax > 0.06)::INTEGER AS VARCHAR) END AS code
  FROM lineitem)
SELECT l_orderkey, l_linenumber, code, CASE code WHEN 'ok' THEN 'ok' WHEN '000' THEN '?' ELSE concat_ws('_',
  CASE WHEN code[1] = '1' THEN 'quantity' END, CASE WHEN code[2] = '1' THEN 'discount' END,
  CASE WHEN code[3] = '1' THEN 'tax' END) END AS cause FROM t""")
def decoded_bits(spark, sf):
    bit = lambda c: c.cast("int").cast("string")
    code = F.when(F.col("l_quantity") < 5, "ok").otherwise(
        F.concat(bit(F.col("l_quantity") > 45), bit(F.col("l_discount") > 0.07), bit(F.col("l_tax") > 0.06)))
    return (table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"))
            .withColumn("cause", S.decode_bits("code", ["quantity", "discount", "tax"])))


# --- panel building and reshaping -------------------------------------------------------

HOURS = [f"h{h:02d}" for h in range(1, 25)]
_HOUR_SQL = ", ".join(f"avg(CASE WHEN hour(ts) = {i} THEN value END) AS {h}" for i, h in enumerate(HOURS))
CTE_DAILY = f"""hourly AS (SELECT event_type AS part, user_id AS station, CAST(ts AS DATE) AS date, {_HOUR_SQL}
  FROM events GROUP BY ALL),
daily AS (SELECT part, station, date, list_avg([{", ".join(HOURS)}]) AS value FROM hourly)"""


def hourly(spark, sf) -> DataFrame:
    """Raw panel: one row per (station, part, day) with 24 hour columns, gaps as NaN in one of
    them and null in the others."""
    hour = F.hour("ts")
    cells = [F.avg(F.when(hour == i, F.col("value"))).alias(h) for i, h in enumerate(HOURS)]
    wide = (table(spark, sf, "events").groupBy(F.col("event_type").alias("part"), F.col("user_id").alias("station"),
                                               F.col("ts").cast("date").alias("date")).agg(*cells))
    return wide.withColumn("h01", F.coalesce("h01", F.lit(float("nan"))))


@register("daily_means", f"WITH {CTE_DAILY} SELECT part, station, date, round(value, 6) AS value FROM daily WHERE value IS NOT NULL")
def daily_means(spark, sf):
    return (hourly(spark, sf).select("part", "station", "date", r6(S.row_mean(HOURS)).alias("value"))
            .filter(F.col("value").isNotNull()))


@register("monthly_means", f"""WITH {CTE_DAILY}, tagged AS (SELECT *, day(date) % 5 AS tag FROM daily WHERE value IS NOT NULL)
SELECT part, station, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, round(avg(value), 9) AS value,
  CAST(arg_min(tag, date) AS INTEGER) AS tag FROM tagged GROUP BY ALL""")
def monthly_means(spark, sf):
    daily = (hourly(spark, sf).select("part", "station", "date", S.row_mean(HOURS).alias("value"))
             .filter(F.col("value").isNotNull())
             .withColumns({"year": F.year("date"), "month": F.month("date"), "tag": F.dayofmonth("date") % 5}))
    out = reshape.monthly_mean(daily, ["part", "station", "year", "month"], "value", ["tag"], "date")
    return out.withColumn("value", F.round("value", 9))


@register("monthly_panel", f"WITH {CTE_PANEL} SELECT station, year, month, {r6_sql(*PARTS)} FROM panel")
def monthly_panel(spark, sf):
    return rounded(panel(spark, sf), PARTS)


@register("pivoted_parts", f"WITH {CTE_PANEL} SELECT station, year, month, {r6_sql(*PARTS)} FROM panel")
def pivoted_parts(spark, sf):
    long = readings(spark, sf).groupBy(*KEY, "part").agg(F.avg("value").alias("value"))
    return rounded(reshape.pivot_parts(long, KEY, "part", "value", PARTS), PARTS)


@register("unpivoted_parts", f"""WITH {CTE_PANEL}, long AS (SELECT station, year, month, unnest({stacked(PARTS)}) AS u FROM panel)
SELECT station, year, month, u.variable AS part, round(u.value, 6) AS value FROM long""")
def unpivoted_parts(spark, sf):
    return rounded(reshape.unpivot(panel(spark, sf), KEY, PARTS, "part"), ["value"])


@register("split_statistics", """
SELECT 'price' AS variable, 'mean' AS statistic, round(avg(o_totalprice), 6) AS value FROM orders
UNION ALL SELECT 'price', 'max', max(o_totalprice) FROM orders
UNION ALL SELECT 'customer', 'max', CAST(max(o_custkey) AS DOUBLE) FROM orders""")
def split_statistics(spark, sf):
    row = table(spark, sf, "orders").agg(r6(F.avg("o_totalprice")).alias("price__mean"), F.max("o_totalprice").alias("price__max"),
                                         F.max("o_custkey").cast("double").alias("customer__max"))
    long = reshape.unpivot(row, [], row.columns, "name")
    variable, statistic = reshape.split_statistic(F.col("name"))
    return long.select(variable.alias("variable"), statistic.alias("statistic"), "value")


# --- joins ------------------------------------------------------------------------------


@register("left_join_one_key", """
SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey""")
def left_join_one_key(spark, sf):
    return joins.lookup_join(table(spark, sf, "customer"), table(spark, sf, "nation").filter("n_regionkey <> 2"),
                             [("c_nationkey", "n_nationkey")], ["n_name"]).select("c_custkey", "c_name", "n_name")


@register("left_join_composite", f"""WITH {CTE_PANEL}, loads AS (
  SELECT CAST(o_custkey % 50 AS BIGINT) AS station, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
    round(avg(o_totalprice), 6) AS load FROM orders GROUP BY ALL)
SELECT station, year, month, round(p_af, 6) AS p_af, load FROM panel LEFT JOIN loads USING (station, year, month)""")
def left_join_composite(spark, sf):
    loads = (table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("station"), F.year("o_orderdate").alias("year"),
                                                F.month("o_orderdate").alias("month"))
             .agg(r6(F.avg("o_totalprice")).alias("load")))
    return panel(spark, sf).join(loads, KEY, "left").select(*KEY, r6("p_af").alias("p_af"), "load")


@register("left_join_renamed", """
SELECT l_orderkey, l_linenumber, p_brand, p_size FROM lineitem LEFT JOIN
  (SELECT p_partkey, p_brand, p_size FROM part WHERE p_size > 10) ON l_partkey = p_partkey""")
def left_join_renamed(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.lookup_join(li, table(spark, sf, "part").filter("p_size > 10"), [("l_partkey", "p_partkey")],
                             ["p_brand", "p_size"]).drop("l_partkey")


CTE_COUNTY_YEAR = """county_year AS (
  SELECT n_name AS county, CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def order_counties(spark, sf) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("n_name").alias("county"), F.year("o_orderdate").alias("year"),
                    F.month("o_orderdate").alias("month"), "o_totalprice"))


@register("expanded_members", f"""WITH {CTE_STATIONS}, {CTE_COUNTY_YEAR}
SELECT county, year, round(value, 6) AS value, municipality FROM county_year LEFT JOIN
  (SELECT DISTINCT county, municipality FROM stations) USING (county)""")
def expanded_members(spark, sf):
    facts = order_counties(spark, sf).groupBy("county", "year").agg(r6(F.avg("o_totalprice")).alias("value"))
    return joins.expand_to_members(facts, stations(spark, sf), "county", "municipality")


@register("crossed_months", f"""WITH {CTE_STATIONS} SELECT station, area, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month
FROM (SELECT station, area FROM stations), range(2020, 2025) t(y), range(1, 13) u(m)""")
def crossed_months(spark, sf):
    return reshape.with_months(stations(spark, sf).select("station", "area"), range(2020, 2025))


@register("excluded_keys", f"""WITH {CTE_PANEL} SELECT station, year, month FROM panel WHERE (station, year, month) NOT IN
  (SELECT (station, year, month) FROM panel WHERE p_af > 40000 AND p_ro IS NULL)""")
def excluded_keys(spark, sf):
    p = panel(spark, sf)
    return joins.exclude(p, p.filter((F.col("p_af") > 40000) & F.col("p_ro").isNull()), KEY).select(*KEY)


@register("merged_conflicts", """
WITH base AS (SELECT l_suppkey AS station, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
    CASE WHEN l_linenumber % 2 = 1 THEN 'urban' ELSE 'suburban' END AS area,
    avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS pm10, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS o3
  FROM lineitem GROUP BY ALL),
donors AS (SELECT station, year, month, pm10, TRUE AS hit FROM base WHERE station % 4 = 1 AND year IN (1997, 1998) AND area = 'suburban')
SELECT b.station, b.year, b.month, b.area, round(CASE WHEN b.area = 'urban' AND b.year IN (1997, 1998) AND d.hit THEN d.pm10 ELSE b.pm10 END, 6) AS pm10,
  round(b.o3, 6) AS o3 FROM base b LEFT JOIN donors d USING (station, year, month)
WHERE NOT (b.station % 4 = 1 AND b.year IN (1997, 1998) AND b.area = 'suburban')""")
def merged_conflicts(spark, sf):
    area = F.when(F.col("l_linenumber") % 2 == 1, "urban").otherwise("suburban")
    base = (table(spark, sf, "lineitem")
            .groupBy(F.col("l_suppkey").alias("station"), F.year("l_shipdate").alias("year"),
                     F.month("l_shipdate").alias("month"), area.alias("area"))
            .agg(F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice"))).alias("pm10"),
                 F.avg(F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice"))).alias("o3")))
    here = (F.col("station") % 4 == 1) & F.col("year").isin(1997, 1998)
    out = joins.merge_conflicts(base, KEY, here & (F.col("area") == "suburban"), here & (F.col("area") == "urban"),
                                "pm10", ["area"])
    return rounded(out, ["pm10", "o3"])


@register("bound_columns", f"""WITH {CTE_STATIONS}, {CTE_SITES}
SELECT station, s.x AS x_station, t.x AS x_site FROM stations s JOIN sites t ON station = site""")
def bound_columns(spark, sf):
    a = stations(spark, sf).select("station", F.col("x").alias("x_station"))
    b = sites(spark, sf).select(F.col("site").alias("station"), F.col("x").alias("x_site"))
    return a.join(b, "station")


@register("appended_rows", f"""WITH {CTE_PANEL}
SELECT station, year, month, round(p_af, 6) AS value, 'af' AS series FROM panel WHERE p_af IS NOT NULL
UNION ALL SELECT station, year, month, round(p_ro, 6), 'ro' FROM panel WHERE p_ro IS NOT NULL""")
def appended_rows(spark, sf):
    p = panel(spark, sf)
    af = p.select(*KEY, r6("p_af").alias("value"), F.lit("af").alias("series")).dropna(subset=["value"])
    ro = p.select(F.lit("ro").alias("series"), r6("p_ro").alias("value"), *KEY).dropna(subset=["value"])
    return af.unionByName(ro)


# --- covariates -------------------------------------------------------------------------

_MONTH_COLS = list(S.MONTHS_ES)


def line_counties(spark, sf) -> DataFrame:
    li, s, n = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    return (li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("n_name").alias("county"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
                    "l_extendedprice", "l_quantity"))


def climate_wide(rows: DataFrame, value: str, prefix: str, names: list[str]) -> DataFrame:
    """County x year table with one column per month name and an annual one."""
    cells = [F.avg(F.when(F.col("month") == i, F.col(value))).alias(f"{prefix}{n}") for i, n in enumerate(names, 1)]
    return rows.groupBy("county", "year").agg(*cells, F.avg(value).alias(f"{prefix}Annual"))


def climate_tables(spark, sf) -> list[tuple[str, str, dict[str, int], DataFrame]]:
    """(value, prefix, month names, wide table) of the three quantities: prices of orders, and prices and quantities of lines."""
    es, ca = "Media mensual. ", "Mitjana mensual. "
    lines = line_counties(spark, sf)
    return [("temp_max", es, S.MONTHS_ES, climate_wide(order_counties(spark, sf), "o_totalprice", es, list(S.MONTHS_ES))),
            ("temp_min", ca, S.MONTHS_CA, climate_wide(lines, "l_extendedprice", ca, list(S.MONTHS_CA))),
            ("rain", ca, S.MONTHS_CA, climate_wide(lines, "l_quantity", ca, list(S.MONTHS_CA)))]


CTE_CLIMATE = """climate AS (
  SELECT n_name AS county, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
    avg(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
 line_climate AS (
  SELECT n_name AS county, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
    avg(l_extendedprice) AS low, avg(l_quantity) AS rain
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""
CTE_FRAME = f"""{CTE_CLIMATE}, years AS (SELECT county, year FROM climate UNION SELECT county, year FROM line_climate),
  frame AS (SELECT county, year, CAST(m AS INTEGER) AS month FROM years, range(1, 13) t(m))"""


@register("climate_long", f"""WITH {CTE_FRAME}
SELECT county, year, month, 'temp_max' AS variable, round(value, 6) AS value FROM frame LEFT JOIN climate USING (county, year, month)
  WHERE EXISTS (SELECT 1 FROM climate c WHERE c.county = frame.county AND c.year = frame.year)
UNION ALL SELECT county, year, month, u.variable, round(u.value, 6) FROM (
  SELECT county, year, month, unnest([{{'variable': 'temp_min', 'value': low}}, {{'variable': 'rain', 'value': rain}}]) AS u
  FROM frame LEFT JOIN line_climate USING (county, year, month)
  WHERE EXISTS (SELECT 1 FROM line_climate c WHERE c.county = frame.county AND c.year = frame.year))""")
def climate_long(spark, sf):
    """The three wide tables, Spanish and Catalan month names, as one long table."""
    out = None
    for name, prefix, months, wide in climate_tables(spark, sf):
        long = reshape.monthly_wide_to_long(wide, ["county", "year"], prefix, months, "value").select(
            "county", "year", "month", F.lit(name).alias("variable"), r6("value").alias("value"))
        out = long if out is None else out.unionByName(long)
    return out


@register("month_names", """SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month_ca FROM orders""")
def month_names(spark, sf):
    names = F.element_at(F.array(*[F.lit(f"Mitjana mensual. {n} ") for n in S.MONTHS_CA]), F.month("o_orderdate"))
    return table(spark, sf, "orders").select(
        "o_orderkey", S.month_number(S.strip_prefix(names, "Mitjana mensual."), S.MONTHS_CA).alias("month_ca"))


@register("urban_classes", f"""WITH {CTE_STATIONS}
SELECT station AS code, CASE station % 4 WHEN 1 THEN 'urban' WHEN 2 THEN 'suburban' WHEN 3 THEN 'rural' END AS area FROM stations""")
def urban_classes(spark, sf):
    from simplexspark.operators.covariates import urban_class

    codes = reshape.with_months(stations(spark, sf).select(F.col("station").alias("code")), [2023, 2024], [1]).select(
        "code", "year", F.when(F.col("year") == 2024, F.col("code") % 4).otherwise(1).alias("degurba"))
    return urban_class(codes, 2024)


CTE_COVARIATES = f"""{CTE_STATIONS}, {CTE_FRAME},
  folded AS (SELECT municipality AS name, CASE county WHEN 'NATION_7' THEN 'NATION_2' ELSE county END AS county FROM stations),
  monthly AS (SELECT name, year, month, value, low, rain FROM folded JOIN frame USING (county) LEFT JOIN climate USING (county, year, month)
    LEFT JOIN line_climate USING (county, year, month)),
  covariates AS (
    SELECT s.station AS code, s.municipality AS name, CAST(t.yy AS INTEGER) AS year, CAST(u.m AS INTEGER) AS month, s.altitude,
      CASE s.station % 4 WHEN 1 THEN 'urban' WHEN 2 THEN 'suburban' WHEN 3 THEN 'rural' END AS area, s.x, s.y,
      v.value AS temp_max, v.low AS temp_min, v.rain AS rain
    FROM stations s CROSS JOIN range(1995, 2002) t(yy) CROSS JOIN range(1, 13) u(m)
    LEFT JOIN monthly v ON v.name = s.municipality AND v.year = t.yy AND v.month = u.m)"""


def covariate_frame(spark, sf) -> DataFrame:
    """Municipality x month frame with the three climate columns and season."""
    from simplexspark.operators import covariates as V

    st = stations(spark, sf)
    places = st.select(F.col("station").alias("code"), F.col("municipality").alias("name"), "altitude", "x", "y")
    areas = urban_classes(spark, sf)
    frame = V.municipality_months(places, areas, range(1995, 2002))
    members = V.fold_group(st.select(F.col("municipality").alias("name"), "county"), {"NATION_7": "NATION_2"})
    return V.attach_climate(frame, [V.climate_to_members(wide, members, prefix, months, name)
                                    for name, prefix, months, wide in climate_tables(spark, sf)])


@register("covariate_frame", f"""WITH {CTE_COVARIATES}
SELECT code, name, year, month, CASE WHEN month IN (12, 1, 2) THEN 'Hivern' WHEN month IN (3, 4, 5) THEN 'Primavera'
  WHEN month IN (6, 7, 8) THEN 'Estiu' ELSE 'Tardor' END AS season, altitude, area, x, y,
  {r6_sql('temp_max', 'temp_min', 'rain')} FROM covariates""")
def covariate_frame_query(spark, sf):
    return rounded(covariate_frame(spark, sf), ["temp_max", "temp_min", "rain"])


@register("station_places", """
SELECT DISTINCT l_suppkey AS station, CASE s_name WHEN 'Supplier#000000003' THEN 'Supplier#3' ELSE s_name END AS municipality,
  n_name AS county FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def station_places(spark, sf):
    from simplexspark.operators.covariates import station_places as places

    raw = readings(spark, sf).select("station").join(stations(spark, sf), "station")
    return places(raw, repair={"Supplier#000000003": "Supplier#3"})


@register("station_covariates", f"""WITH {CTE_PANEL}, {CTE_COVARIATES}
SELECT station, p.year, p.month, round(p_af, 6) AS p_af, s.municipality, round(c.temp_max, 6) AS temp_max, round(c.rain, 6) AS rain
FROM panel p JOIN stations s USING (station) LEFT JOIN covariates c ON c.name = s.municipality AND c.year = p.year AND c.month = p.month""")
def station_covariates(spark, sf):
    from simplexspark.operators.covariates import attach_station_covariates

    p = panel(spark, sf).join(stations(spark, sf).select("station", "municipality"), "station")
    out = attach_station_covariates(p.select(*KEY, "p_af", "municipality"), covariate_frame(spark, sf), ["temp_max", "rain"])
    return rounded(out, ["p_af", "temp_max", "rain"])


@register("clipped_municipalities", f"""WITH {CTE_STATIONS}, {OUTLINE_SQL},
  edge AS (SELECT a.region, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM outline a JOIN outline b
    ON a.region = b.region AND b.seq = CASE WHEN a.seq = (SELECT max(seq) FROM outline c WHERE c.region = a.region) THEN 1 ELSE a.seq + 1 END)
SELECT station AS code, municipality AS name, altitude, region FROM stations JOIN edge
  ON (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
GROUP BY ALL HAVING count(*) % 2 = 1""")
def clipped_municipalities(spark, sf):
    from simplexspark.operators.geometry import within

    st = stations(spark, sf).select(F.col("station").alias("code"), F.col("municipality").alias("name"), "altitude", "x", "y")
    return within(st, outlines(spark, sf)).drop("x", "y")
