"""Chains from fitted models to their tables."""

import pandas as pd
from pyspark.sql import functions as F

from simplexspark.operators import robust
from simplexspark.operators import surface as M

FLAGS = "area string, outlier string, n_observed int, outlier_cause string, x int"


def test_screen_tables_count_what_was_flagged(spark):
    rows = [("a", "Outlier", 2 + i % 3, "p_af" if i % 2 else "?", 1) for i in range(11)] + [("a", "No outlier", 6, "ok", 1)] * 9
    rows += [("b", "No outlier", 3, "ok", 2)] * 4 + [("b", None, 5, None, 2)] * 3 + [(None, "Outlier", 3, "p_ro", 3)] * 2
    pdf = pd.DataFrame(rows, columns=["area", "outlier", "n_observed", "cause", "x"])
    got = {(r.report, r.area, r.outlier, r.detail): (r.n, r.value) for r in robust.screen_tables(spark.createDataFrame(rows, FLAGS), ["area"]).collect()}
    known, want = pdf[pdf.outlier.notna()], {}
    for area in ("a", "b", None):
        own = known[known.area.isna() if area is None else known.area == area]
        bad = own[own.outlier == "Outlier"]
        for flag in own.outlier.unique():
            n = int((own.outlier == flag).sum())
            want["shares", area, flag, None] = (n, n / len(own))
            left = own[(own.outlier == flag) & ~((own.outlier == "Outlier") & (own.n_observed <= 3))]
            if len(left):
                want["kept", area, flag, None] = (len(left), None)
        want.update({("observed", area, "Outlier", str(v)): (int(n), None) for v, n in bad.n_observed.value_counts().items()})
        want.update({("causes", area, "Outlier", v): (int(n), None) for v, n in bad.cause.value_counts().items()})
        want["rates", area, None, None] = (len(own), 100 * len(bad) / len(own))
    assert got == want
    assert robust.screen_tables(spark.createDataFrame([], FLAGS), ["area"]).count() == 0


def test_long_surface_store_and_own_extent(spark, tmp_path):
    pred = spark.range(48).select("id", (F.col("id") % 2).alias("x"), F.lit(5.0).alias("y"), F.floor(F.col("id") / 2).cast("int").alias("ym"),
                                  *[(F.col("id") * k + d).alias(f"{s}_{r}") for r, k in (("A", 1.0), ("B", -10.0)) for s, d in (("mean", 0), ("ll", -1), ("ul", 1))],
                                  F.lit("extra").alias("sd_A"))
    path = f"file://{tmp_path}/p"
    long = M.long_surface(pred, ["A", "B"], 0)
    assert long.columns == ["x", "y", "ym", "response", "statistic", "value", "date"] and long.count() == 48 * 6
    M.store_predictions(long, path)
    M.store_predictions(long.where("response = 'A' AND year(date) = 2021").withColumn("value", F.lit(7.0)), path)
    back = M.stored_predictions(spark, path)
    assert back.count() == 48 * 6
    assert {r[0] for r in back.where("response = 'A' AND year = 2021").select("value").distinct().collect()} == {7.0}
    assert back.where("response = 'B' AND value = 7").count() == 0
    shown = M.clamp_display(long, by=["response"]).toPandas()
    for _, own in shown.groupby("response"):
        assert own.position.min() == 0 and own.position.max() == 1 and (own.shown == own.value).all()
    one = M.clamp_display(long.limit(1), by=["response"]).first()
    assert one.position is None and one.shown == one.value
    assert M.clamp_display(long, (0.0, 10.0)).agg(F.min("shown"), F.max("position")).first() == (0.0, 1.0)
