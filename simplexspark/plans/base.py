"""Shared inputs of the registered queries, built from the given tables.

Stations are suppliers, the six parts are the return-flag/line-status pairs, a reading is a
line's extended price; county and municipality are nation and supplier. The same
definitions in SQL are the CTEs below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexspark.functions.simplex import to_tspace
from simplexspark.operators.reshape import min_observed, monthly_wide

Query = tuple[Callable[[SparkSession, str], DataFrame], "str | None"]

PARTS = ["p_af", "p_ao", "p_nf", "p_no", "p_rf", "p_ro"]
SIGNS = {
    "B1": {"p_af": 1, "p_ao": -1, "p_rf": -1, "p_ro": -1, "p_nf": -1, "p_no": -1},
    "B2": {"p_ao": 1, "p_nf": 1, "p_no": 1, "p_rf": -1, "p_ro": -1},
    "B3": {"p_ao": 1, "p_nf": 1, "p_no": -1},
    "B4": {"p_ao": 1, "p_nf": -1},
    "B5": {"p_ro": 1, "p_rf": -1},
}
COORDS = ["Total", "B1", "B2", "B3", "B4", "B5"]
TYPES = ["background", "traffic", "industrial"]
AREAS = ["urban", "suburban", "rural"]
KEY = ["station", "year", "month"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per reading: station, part, date, value."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("station"),
        F.concat(F.lit("p_"), F.lower(F.concat("l_returnflag", "l_linestatus"))).alias("part"),
        F.col("l_shipdate").cast("date").alias("date"), F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"), F.col("l_extendedprice").alias("value"), "l_orderkey", "l_linenumber")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_wide(readings(spark, sf), KEY, "part", "value", PARTS)


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return min_observed(panel(spark, sf), PARTS, 2)


def complete(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).dropna(subset=PARTS)


def tspace(spark: SparkSession, sf: str) -> DataFrame:
    return to_tspace(complete(spark, sf), PARTS, SIGNS)


def stations(spark: SparkSession, sf: str) -> DataFrame:
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    k = F.col("s_suppkey")
    pick = lambda labels, c: F.element_at(F.array(*[F.lit(v) for v in labels]), (c + 1).cast("int"))
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        k.alias("station"), pick(TYPES, k % 3).alias("station_type"), pick(AREAS, F.col("n_regionkey") % 3).alias("area"),
        F.col("s_name").alias("municipality"), F.col("n_name").alias("county"), F.col("s_acctbal").alias("altitude"),
        ((k * 7919) % 10007).cast("double").alias("x"), ((k * 104729) % 10009).cast("double").alias("y"))


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Customer points on the same plane as the stations."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("site"), ((k * 6563) % 10007).cast("double").alias("x"), ((k * 48611) % 10009).cast("double").alias("y"))


_AVG = ",\n    ".join(
    f"avg(l_extendedprice) FILTER (WHERE 'p_' || lower(l_returnflag || l_linestatus) = '{p}') AS {p}" for p in PARTS)
CTE_PANEL = f"""panel AS (
  SELECT l_suppkey AS station, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
    {_AVG}
  FROM lineitem GROUP BY ALL)"""
_NOBS = " + ".join(f"({p} IS NOT NULL)::INTEGER" for p in PARTS)
CTE_KEPT = f"{CTE_PANEL}, kept AS (SELECT * FROM panel WHERE {_NOBS} >= 2)"
CTE_COMPLETE = f"{CTE_PANEL}, complete AS (SELECT * FROM panel WHERE {_NOBS} = 6)"
COORD_SQL = {
    "B1": "sqrt(5e0/6) * (ln(p_af) - (ln(p_ao) + ln(p_rf) + ln(p_ro) + ln(p_nf) + ln(p_no)) / 5)",
    "B2": "sqrt(6e0/5) * ((ln(p_ao) + ln(p_nf) + ln(p_no)) / 3 - (ln(p_rf) + ln(p_ro)) / 2)",
    "B3": "sqrt(2e0/3) * ((ln(p_ao) + ln(p_nf)) / 2 - ln(p_no))",
    "B4": "sqrt(5e-1) * ln(p_ao / p_nf)",
    "B5": "sqrt(5e-1) * ln(p_ro / p_rf)",
    "Total": "(ln(p_af) + ln(p_ao) + ln(p_nf) + ln(p_no) + ln(p_rf) + ln(p_ro)) / sqrt(6e0)",
}
CTE_TSPACE = (f"{CTE_COMPLETE}, tspace AS (SELECT station, year, month, "
              + ", ".join(f"{e} AS {n}" for n, e in COORD_SQL.items()) + " FROM complete)")
CTE_STATIONS = """stations AS (
  SELECT s_suppkey AS station, (['background', 'traffic', 'industrial'])[s_suppkey % 3 + 1] AS station_type,
    (['urban', 'suburban', 'rural'])[n_regionkey % 3 + 1] AS area, s_name AS municipality, n_name AS county,
    s_acctbal AS altitude, CAST((s_suppkey * 7919) % 10007 AS DOUBLE) AS x,
    CAST((s_suppkey * 104729) % 10009 AS DOUBLE) AS y
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
CTE_SITES = """sites AS (SELECT c_custkey AS site, CAST((c_custkey * 6563) % 10007 AS DOUBLE) AS x,
    CAST((c_custkey * 48611) % 10009 AS DOUBLE) AS y FROM customer)"""


def r6_sql(*exprs: str) -> str:
    """``a AS b`` items rounded to six places."""
    out = []
    for e in exprs:
        body, _, name = e.rpartition(" AS ")
        out.append(f"round({body or name}, 6) AS {name}")
    return ", ".join(out)


def stacked(names: list[str]) -> str:
    """SQL list of structs for unpivoting with nulls kept."""
    return "[" + ", ".join(f"{{'variable': '{n}', 'value': {n}}}" for n in names) + "]"
