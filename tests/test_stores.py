"""Stored sketches and the partitioned prediction store."""

import os

from pyspark.sql import functions as F

from simplexspark.operators import stats
from simplexspark.operators import surface as M


def test_merged_sketches_are_those_of_the_whole(spark):
    rows = spark.range(60_000).select((F.col("id") % 12).alias("month"), (F.col("id") % 5_003).alias("a"), F.when(F.col("id") % 2 == 0, (F.col("id") % 700).cast("string")).alias("b"))
    monthly = stats.distinct_sketches(rows, ["month"], ["a", "b"])
    merged = stats.merged_counts(monthly, [], ["a", "b"]).first()
    whole = stats.merged_counts(stats.distinct_sketches(rows, [], ["a", "b"]), [], ["a", "b"]).first()
    assert merged == whole and abs(merged.a / 5_003 - 1) < 0.08 and abs(merged.b / 350 - 1) < 0.08
    assert stats.merged_counts(stats.distinct_sketches(rows.limit(0), ["month"], ["a"]), ["month"], ["a"]).count() == 0


def test_rerun_replaces_its_year_only(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    pred = spark.range(24).select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.col("id").cast("int").alias("ym"), F.col("id").cast("double").alias("pred_mean"),
                                  F.lit(-1.0).alias("pred_ll"), F.lit(9.0).alias("pred_ul"))
    long = M.long_predictions(pred, 0)
    M.store_predictions(long, path)
    folder = tmp_path / "p" / "statistic=pred_mean" / "year=2020"
    before = sorted(os.listdir(folder))
    M.store_predictions(long.filter(F.year("date") == 2021).withColumn("value", F.col("value") * 10), path)
    got = {r.ym: r.value for r in M.stored_predictions(spark, path, "pred_mean").collect()}
    assert got == {i: float(i if i < 12 else 10 * i) for i in range(24)} and sorted(os.listdir(folder)) == before
    assert M.stored_predictions(spark, path, years=[2021]).count() == 36
    plan = M.stored_predictions(spark, path, "pred_ul", [2021])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "statistic" in plan.split("PartitionFilters: [")[1].split("]")[0]
