"""Projection, lattices, outlines, rasters, nearest places, lattice covariates."""

from __future__ import annotations

from pyspark.sql import functions as F

from simplexspark.operators import covariates as V
from simplexspark.operators import geometry as G
from simplexspark.operators.cells import cell_knn
from simplexspark.operators.knn import knn_join
from simplexspark.operators.reshape import with_months
from simplexspark.plans.base import CTE_SITES, CTE_STATIONS, Query, r6, r6_sql, rounded, sites, stations, table
from simplexspark.plans.panel import CTE_COVARIATES, OUTLINE_SQL, RASTER_SQL, covariate_frame, outlines, raster

QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f
    return keep


# The same Krueger series written out for the SQL twin.
def _utm_sql() -> str:
    f = G.FLATTENING
    n = f / (2 - f)
    rect = G.SEMI_MAJOR / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    a = [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440,
         61 * n ** 3 / 240 - 103 * n ** 4 / 140, 49561 * n ** 4 / 161280]
    ecc = 2 * n ** 0.5 / (1 + n)
    east = " + ".join(f"{v!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(a, 1))
    north = " + ".join(f"{v!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(a, 1))
    return f"""geo AS (SELECT c_custkey AS site, 0.2 + (c_custkey * 6563 % 10007) / 3e3 AS lon, 40.5 + (c_custkey * 48611 % 10009) / 4.5e3 AS lat FROM customer),
 u1 AS (SELECT *, radians(lon - 3) AS lam, sinh(atanh(sin(radians(lat))) - {ecc!r} * atanh({ecc!r} * sin(radians(lat)))) AS t FROM geo),
 u2 AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM u1),
 utm AS (SELECT site, lon, lat, 500000 + {0.9996 * rect!r} * (eta + {east}) AS x, {0.9996 * rect!r} * (xi + {north}) AS y FROM u2)"""


def geo_sites(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("site"), (F.lit(0.2) + (k * 6563 % 10007) / F.lit(3e3)).alias("lon"),
                                               (F.lit(40.5) + (k * 48611 % 10009) / F.lit(4.5e3)).alias("lat"))


@register("utm_positions", f"WITH {_utm_sql()} SELECT site, {r6_sql('lon', 'lat')}, round(x, 4) AS x, round(y, 4) AS y FROM utm")
def utm_positions(spark, sf):
    out = G.project(geo_sites(spark, sf), "lon", "lat")
    return rounded(out, ["lon", "lat"]).withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


CTE_EDGE = """edge AS (SELECT a.region, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM outline a JOIN outline b
    ON a.region = b.region AND b.seq = CASE WHEN a.seq = (SELECT max(seq) FROM outline c WHERE c.region = a.region) THEN 1 ELSE a.seq + 1 END)"""
INSIDE = "(y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)"


@register("points_in_outline", f"""WITH {CTE_SITES}, {OUTLINE_SQL}, {CTE_EDGE}
SELECT site, region FROM sites JOIN edge ON {INSIDE} GROUP BY ALL HAVING count(*) % 2 = 1""")
def points_in_outline(spark, sf):
    return G.within(sites(spark, sf), outlines(spark, sf)).select("site", "region")


@register("outline_edges", f"WITH {OUTLINE_SQL}, {CTE_EDGE} SELECT region, {r6_sql('x1', 'y1', 'x2', 'y2')} FROM edge")
def outline_edges(spark, sf):
    return rounded(G.edges(outlines(spark, sf)), ["x1", "y1", "x2", "y2"])


GRID = 100
YEARS = range(1995, 2002)


def _grid_sql(n: int) -> str:
    return f"""box AS (SELECT min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1 FROM sites),
  grid AS (SELECT i AS cell, x0 + (i % {n}) * ((x1 - x0) / {n - 1}) AS x, y0 + (i // {n}) * ((y1 - y0) / {n - 1}) AS y FROM box, range({n * n}) t(i))"""


def grid(spark, sf, n: int = GRID):
    return G.make_grid(spark, G.bounding_box(sites(spark, sf)), n, n)


@register("lattice", f"WITH {CTE_SITES}, {_grid_sql(100)} SELECT cell, {r6_sql('x', 'y')} FROM grid")
def lattice(spark, sf):
    return rounded(grid(spark, sf, 100), ["x", "y"])


@register("clipped_lattice", f"""WITH {CTE_SITES}, {_grid_sql(GRID)}, {OUTLINE_SQL}, {CTE_EDGE}
SELECT cell, {r6_sql('x', 'y')}, region FROM grid JOIN edge ON {INSIDE} GROUP BY ALL HAVING count(*) % 2 = 1""")
def clipped_lattice(spark, sf):
    return rounded(G.within(grid(spark, sf), outlines(spark, sf)), ["x", "y"])


@register("sampled_raster", f"""WITH {CTE_SITES}, {RASTER_SQL}
SELECT site, round(value, 6) AS value FROM sites LEFT JOIN raster ON cell_x = CAST(floor(x / 110) AS BIGINT) AND cell_y = CAST(floor(y / 120) AS BIGINT)""")
def sampled_raster(spark, sf):
    # Cells are 110 wide and 120 high: two axes with their own size.
    keyed = sites(spark, sf).withColumn("y", F.col("y") * 110 / 120)
    return rounded(G.sample_raster(keyed, raster(spark, sf), (0, 0), 110).select("site", "value"), ["value"])


CTE_ELEV = f"""{CTE_SITES}, {_grid_sql(GRID)}, {RASTER_SQL},
  elev AS (SELECT cell, x, y, CASE WHEN value < 0 THEN 0 ELSE value END AS altitude FROM grid JOIN raster
    ON cell_x = CAST(floor(x / 110) AS BIGINT) AND cell_y = CAST(floor(y / 110) AS BIGINT) WHERE value IS NOT NULL)"""


@register("lattice_elevation", f"WITH {CTE_ELEV} SELECT cell, {r6_sql('x', 'y', 'altitude')} FROM elev")
def lattice_elevation(spark, sf):
    return rounded(G.grid_elevation(grid(spark, sf), raster(spark, sf), (0, 0), 110).select("cell", "x", "y", "altitude"),
                   ["x", "y", "altitude"])


@register("prepared_raster", f"""WITH {_utm_sql()}, cells AS (SELECT x, y, site % 500 - 20 AS value FROM utm WHERE x BETWEEN 300000 AND 450000 AND y BETWEEN 4500000 AND 4700000)
SELECT CAST(floor((x - 260000) / 5000) AS BIGINT) AS cell_x, CAST(floor((y - 4480000) / 5000) AS BIGINT) AS cell_y, round(avg(value), 6) AS value
FROM cells GROUP BY ALL""")
def prepared_raster(spark, sf):
    cells = geo_sites(spark, sf).withColumn("value", F.col("site") % 500 - 20)
    return rounded(G.prepare_raster(cells, (260000, 4480000), 5000, 31, (300000, 4500000, 450000, 4700000)), ["value"])


def _inverse_sql() -> str:
    """Degrees of the target centres (cell, x, y), as in ``from_utm``."""
    f = G.FLATTENING
    n = f / (2 - f)
    k = 0.9996 * G.SEMI_MAJOR / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    b = [n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 - n ** 4 / 360, n ** 2 / 48 + n ** 3 / 15 - 437 * n ** 4 / 1440,
         17 * n ** 3 / 480 - 37 * n ** 4 / 840, 4397 * n ** 4 / 161280]
    d = [2 * n - 2 * n ** 2 / 3 - 2 * n ** 3 + 116 * n ** 4 / 45, 7 * n ** 2 / 3 - 8 * n ** 3 / 5 - 227 * n ** 4 / 45,
         56 * n ** 3 / 15 - 136 * n ** 4 / 35, 4279 * n ** 4 / 630]
    xi = " - ".join(["xi", *[f"{v!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(b, 1)]])
    eta = " - ".join(["eta", *[f"{v!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(b, 1)]])
    phi = " + ".join(["chi", *[f"{v!r} * sin({2 * j} * chi)" for j, v in enumerate(d, 1)]])
    return f"""i1 AS (SELECT *, y / {k!r} AS xi, (x - 500000) / {k!r} AS eta FROM target), i2 AS (SELECT *, {xi} AS xi0, {eta} AS eta0 FROM i1),
 i3 AS (SELECT *, asin(sin(xi0) / cosh(eta0)) AS chi FROM i2), back AS (SELECT cell_x, cell_y, x, y, degrees(atan2(sinh(eta0), cos(xi0))) + 3 AS lon, degrees({phi}) AS lat FROM i3)"""


#: The outline of the places, laid over the projected plane in metres.
_METRES = "CAST(260000 + lon * 22 AS DOUBLE) AS lon, CAST(4480000 + lat * 22 AS DOUBLE) AS lat"
WARP_BOX = (250000, 4470000, 500000, 4720000)


@register("warped_raster", f"""WITH {_utm_sql()}, src AS (SELECT CAST(floor((lon - 0.2) / 0.1) AS BIGINT) AS cx, CAST(floor((lat - 40.5) / 0.1) AS BIGINT) AS cy, avg(site % 500 - 20) AS value
  FROM geo GROUP BY ALL), {OUTLINE_SQL.replace('outline AS', 'plane AS')}, outline AS (SELECT region, ring, seq, {_METRES} FROM plane), {CTE_EDGE},
 tiles AS (SELECT i % 125 AS cell_x, i // 125 AS cell_y, 250000 + (i % 125 + 0.5) * 2e3 AS x, 4470000 + (i // 125 + 0.5) * 2e3 AS y FROM range(15625) t(i)),
 hit AS (SELECT cell_x, cell_y, x, y, region FROM tiles JOIN edge ON {INSIDE} GROUP BY ALL HAVING count(*) % 2 = 1),
 target AS (SELECT DISTINCT cell_x, cell_y, x, y FROM hit), {_inverse_sql()},
 f AS (SELECT *, (lon - 0.2) / 0.1 - 0.5 AS fx, (lat - 40.5) / 0.1 - 0.5 AS fy FROM back),
 four AS (SELECT f.*, CASE a WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END * CASE b WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END AS w,
   CAST(floor(fx) AS BIGINT) + a AS cx, CAST(floor(fy) AS BIGINT) + b AS cy FROM f, range(2) p(a), range(2) q(b))
SELECT cell_x, cell_y, round(x, 6) AS x, round(y, 6) AS y, round(sum(w * value), 6) AS value FROM four LEFT JOIN src USING (cx, cy) WHERE w > 0
GROUP BY ALL HAVING count(*) = count(value)""")
def warped_raster(spark, sf):
    """Degrees to metres by inverse mapping, inside the outlines only."""
    src = geo_sites(spark, sf).withColumn("value", F.col("site") % 500 - 20)
    src = src.groupBy(G.cell_id("lon", 0.2, 0.1).alias("cell_x"), G.cell_id("lat", 40.5, 0.1).alias("cell_y")).agg(F.avg("value").alias("value"))
    metres = outlines(spark, sf).withColumns({"lon": F.lit(260000.0) + F.col("lon") * 22, "lat": F.lit(4480000.0) + F.col("lat") * 22})
    return rounded(G.warp_raster(src, (0.2, 40.5), 0.1, WARP_BOX, 2000, 31, metres), ["x", "y", "value"])


_NEAR = """near AS (SELECT {left}.{id} AS {id}, arg_min(station, ROW((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), station)) AS code
  FROM {left} p CROSS JOIN stations s GROUP BY ALL)"""


@register("nearest_places", f"""WITH {CTE_SITES}, {CTE_STATIONS}, d AS (SELECT site, station AS code,
    sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS distance FROM sites p CROSS JOIN stations s)
SELECT site, code, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY site ORDER BY distance, code) = 1""")
def nearest_places(spark, sf):
    st = stations(spark, sf).select(F.col("station").alias("code"), "x", "y")
    return knn_join(sites(spark, sf), st, ["x", "y"], 1, "site", "code").select("site", "code", r6("distance").alias("distance"))


@register("nearest_vectors", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 d AS (SELECT l.vec_id, r.vec_id AS other, l.label, list_distance(l.x, r.x) AS distance FROM v l JOIN v r ON l.label = r.label)
SELECT vec_id, other, label, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) AS INTEGER) AS rank
FROM d QUALIFY rank <= 4""")
def nearest_vectors(spark, sf):
    """Four nearest vectors of the same label, over all components."""
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    asks = v.select(F.struct("vec_id", "label").alias("lid"), F.col("label").alias("root"), F.lit(0).alias("w"), "x")
    near = cell_knn(asks, v.select(F.col("vec_id").alias("rid"), F.col("label").alias("root"), "x"), 4, 64)
    return near.select("lid.vec_id", F.col("rid").alias("other"), "lid.label", r6(F.sqrt("d2")).alias("distance"), "rank")


@register("lattice_months", f"""WITH {CTE_ELEV} SELECT cell, round(altitude, 6) AS altitude, CAST(t.yy AS INTEGER) AS year, CAST(u.m AS INTEGER) AS month
FROM elev, range({YEARS[0]}, {YEARS[-1] + 1}) t(yy), range(1, 13) u(m)""")
def lattice_months(spark, sf):
    base = G.grid_elevation(grid(spark, sf), raster(spark, sf), (0, 0), 110)
    return with_months(base.select("cell", r6("altitude").alias("altitude")), YEARS)


def lattice_frame(spark, sf, years=YEARS):
    """Lattice-months with elevation, nearest place and that place's covariates."""
    base = G.grid_elevation(grid(spark, sf), raster(spark, sf), (0, 0), 110).select("cell", "x", "y", "altitude")
    places = stations(spark, sf).select(F.col("station").alias("code"), "x", "y")
    near = V.nearest_place(base, places, "cell", "code")
    cov = covariate_frame(spark, sf)
    return V.grid_covariates(with_months(near, years), cov, ["temp_max", "temp_min", "rain"])


@register("lattice_covariates", f"""WITH {CTE_COVARIATES}, {CTE_ELEV},
 near AS (SELECT cell, arg_min(station, ROW((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), station)) AS code FROM elev p CROSS JOIN stations s GROUP BY ALL)
SELECT e.cell, {r6_sql('e.x AS x', 'e.y AS y', 'e.altitude AS altitude')}, n.code, c.name, c.area, c.year, c.month, CAST(c.year * 12 + c.month AS INTEGER) AS ym,
  {r6_sql('temp_max', 'temp_min', 'rain')}
FROM elev e JOIN near n USING (cell) JOIN covariates c ON c.code = n.code""")
def lattice_covariates(spark, sf):
    out = lattice_frame(spark, sf)
    return rounded(out, ["x", "y", "altitude", "temp_max", "temp_min", "rain"])
