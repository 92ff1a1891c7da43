"""Covariate frames: municipality attributes and monthly climate by key joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexspark.functions.scalars import URBAN_CODES, lookup, month_index, recode, season
from simplexspark.operators.joins import expand_to_members, lookup_join
from simplexspark.operators.knn import knn_join
from simplexspark.operators.reshape import mean_duplicates, monthly_wide_to_long, relocate, with_months


def urban_class(codes: DataFrame, year: int, labels: Mapping[int, str] = URBAN_CODES) -> DataFrame:
    """(code, area) of one year."""
    return codes.filter(F.col("year") == year).select("code", lookup("degurba", labels).alias("area"))


def municipality_months(places: DataFrame, areas: DataFrame, years: Sequence[int],
                        months: Sequence[int] = range(1, 13)) -> DataFrame:
    """Municipality x year x month frame with altitude, area and position."""
    base = places.join(areas, "code", "left").select("code", "name", "altitude", "area", "x", "y")
    return relocate(with_months(base, years, months), ["year", "month"], "name")


def fold_group(membership: DataFrame, fold: Mapping[str, str], group: str = "county") -> DataFrame:
    """Put the members of a renamed or new group back under its predecessor."""
    return membership.withColumn(group, recode(group, fold))


def climate_to_members(wide: DataFrame, membership: DataFrame, prefix: str, months: Mapping[str, int], value: str,
                       group: str = "county", member: str = "name") -> DataFrame:
    """County table with twelve month columns to (member, year, month, value). Repeated rows
    of a county-month are averaged before the expansion, which then cannot multiply them."""
    long = mean_duplicates(monthly_wide_to_long(wide, [group, "year"], prefix, months, value),
                           [group, "year", "month"], [value])
    return expand_to_members(long, membership, group, member).select(member, "year", "month", value)


def attach_climate(frame: DataFrame, tables: Sequence[DataFrame], member: str = "name") -> DataFrame:
    """Left-join every climate table on (member, year, month) and add the season."""
    for t in tables:
        frame = frame.join(t, [member, "year", "month"], "left")
    return relocate(frame.withColumn("season", season("month")), ["season"], "month")


def station_places(panel: DataFrame, station: str = "station", repair: Mapping[str, str] | None = None) -> DataFrame:
    """Distinct station, municipality and county of the raw panel, with truncated
    municipality names repaired."""
    places = panel.select(station, "municipality", "county")
    return (places.withColumn("municipality", recode("municipality", repair)) if repair else places).distinct()


def attach_station_covariates(panel: DataFrame, covariates: DataFrame, carry: Sequence[str],
                              member: str = "municipality") -> DataFrame:
    return lookup_join(panel, covariates, [(member, "name"), ("year", "year"), ("month", "month")], carry)


def nearest_place(points: DataFrame, places: DataFrame, point_id: str, place_id: str) -> DataFrame:
    """Code of the nearest place for every point. Runs before points are repeated over
    months, so each location is searched once."""
    sites = places.select(place_id, "x", "y").distinct()
    near = knn_join(points, sites, ["x", "y"], 1, point_id, place_id)
    return points.join(near.select(point_id, place_id), point_id, "left")


def grid_covariates(grid_months: DataFrame, covariates: DataFrame, values: Sequence[str]) -> DataFrame:
    """Covariates of the lattice by (code, month index), duplicates collapsed to their mean
    before the join so that it cannot fan out."""
    cov = covariates.withColumn("ym", month_index("year", "month"))
    cov = mean_duplicates(cov, ["code", "name", "area", "ym"], values)
    return grid_months.withColumn("ym", month_index("year", "month")).join(cov, ["code", "ym"], "left")
