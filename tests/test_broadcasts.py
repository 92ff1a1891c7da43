"""Tables that grow, or that are opened up after they were read, are met by shuffles, however small their files are."""

from pyspark.sql import functions as F

from simplexspark.operators import surface as M
from simplexspark.operators.knn import _attach
from simplexspark.sources import cut


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_targets_residuals_and_cells_stay_off_the_driver(spark):
    rows = cut(spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 20).alias("station"), (F.col("id") % 20).cast("double").alias("x"),
                                       (F.col("id") % 7).cast("double").alias("y"), F.floor(F.col("id") / 20).cast("int").alias("ym"), F.randn(3).alias("res_v")))
    assert broadcasts(M.ar1(rows, ["res_v"], "station")) == 0
    assert broadcasts(M.variogram(rows, ["res_v"], "x", "y", ["ym"], 10.0)) == 0
    hits = rows.select("ym", "x", "y", F.lit(1).cast("long").alias("__rid"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
    found = _attach(rows, hits, ["ym"], ["x", "y"], "station", "row_id").filter(F.col("row_id").isNotNull())
    assert broadcasts(found) == 0 and found.count() == 400
