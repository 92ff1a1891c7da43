"""Joins, quantiles, ranking, nearest neighbours and geometry against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from simplexspark.operators import geometry as G
from simplexspark.operators import stats
from simplexspark.operators.joins import exclude, merge_conflicts
from simplexspark.operators.knn import knn_join
from simplexspark.operators.quantiles import exact_quantiles, order_statistic
from simplexspark.operators.ranking import acf, add_row_id, pacf, split_exact
from simplexspark.operators.stats import contingency, profile
from simplexspark.sources import materialise, read_table, scratch_root


def brute(left, right, cols, k, block=None):
    out = {}
    for _, l in left.iterrows():
        r = right if block is None else right[right[block] == l[block]]
        d = np.zeros(len(r))
        for c in cols:
            d = d + (l[c] - r[c].to_numpy()) ** 2
        order = np.lexsort((r["rid"].to_numpy(), d))[:k]
        out[l["lid"]] = r["rid"].to_numpy()[order].tolist()
    return out


@pytest.mark.parametrize("d,skewed", [(2, False), (2, True), (4, True)])
def test_knn_join_equals_brute_force(spark, d, skewed):
    """A third of both sides in one spot, some of it coincident, changes nothing."""
    rng = np.random.default_rng(d)
    cols = [f"c{i}" for i in range(d)]
    right = pd.DataFrame(rng.normal(size=(600, d)), columns=cols)
    left = pd.DataFrame(rng.normal(size=(120, d)), columns=cols)
    if skewed:
        right.loc[:200, cols] = 0.5 + 1e-3 * rng.normal(size=(201, d))
        right.loc[:60, cols] = 0.5
        left.loc[:40, cols] = 0.5 + 1e-3 * rng.normal(size=(41, d))
    right["rid"], left["lid"] = np.arange(600), np.arange(120)
    got = knn_join(spark.createDataFrame(left), spark.createDataFrame(right), cols, 4, "lid", "rid").toPandas()
    got = got.sort_values(["lid", "rank"]).groupby("lid")["rid"].apply(list).to_dict()
    assert got == brute(left, right, cols, 4)


def test_knn_join_blocks_and_left_rows_without_donors(spark):
    left = spark.createDataFrame([(1, "a", 0.0), (2, "b", 0.0), (3, "a", None)], "lid int, g string, x double")
    right = spark.createDataFrame([(7, "a", 3.0), (8, "a", -3.0)], "rid int, g string, x double")
    got = {(r["lid"], r["rid"], r["distance"]) for r in knn_join(left, right, ["x"], 3, "lid", "rid", ["g"]).collect()}
    assert got == {(1, 7, 3.0), (1, 8, 3.0), (2, None, None), (3, None, None)}


def test_refined_quantiles_equal_numpy_with_ties_and_far_values(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.lognormal(2, 2, 3000), np.full(2000, 1.5), [1e300, -1e300, 0.0]])
    g = np.where(np.arange(v.size) % 3 == 0, "hot", "cold").astype(object)
    g[:5] = None
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))
    for limit in (10, 10 ** 6):
        got = exact_quantiles(df, ["g"], "v", [0, 0.25, 0.5, 0.9, 1], list("abcde"), limit).collect()
        for row in got:
            mine = v[[x == row["g"] for x in g]]
            assert np.allclose(list(row)[1:], np.quantile(mine, [0, 0.25, 0.5, 0.9, 1]), rtol=1e-12)


def test_order_statistic_narrowing(spark):
    v = np.random.default_rng(4).exponential(size=5000)
    v[:1500] = 0.25
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    for rank in (1, 700, 2500, 5000):
        assert order_statistic(df, "v", rank, accuracy=50) == np.sort(v)[rank - 1] == order_statistic(df, "v", rank, 5000)
    with pytest.raises(ValueError):
        order_statistic(df, "v", 5001)


def test_quantiles_of_hot_groups_infinite_and_missing_values(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=20000), np.full(9000, 0.5), [np.inf, -np.inf]])
    g = np.where(np.arange(v.size) % 10 == 0, "b", "a")
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v})).repartition(7)
    gaps = spark.createDataFrame([("a", float("nan")), ("a", None), ("none", float("nan")), ("none", None)], "g string, v double")
    probs = [0.0, 0.001, 0.25, 0.5, 0.5001, 0.9, 1.0]
    for accuracy in (100, 1000, 10000):
        got = exact_quantiles(df.unionByName(gaps), ["g"], "v", probs, list("hijklmn"), accuracy).collect()
        assert {r["g"] for r in got} == {"a", "b"}
        for row in got:
            mine = np.sort(v[g == row["g"]])
            at = np.array(probs) * (mine.size - 1)
            lo, part = np.floor(at).astype(int), at - np.floor(at)
            hi = np.ceil(at).astype(int)
            want = [mine[a] if mine[a] == mine[b] else (1 - t) * mine[a] + t * mine[b] for a, b, t in zip(lo, hi, part)]
            assert np.allclose(list(row)[1:], want, rtol=1e-9)
    assert exact_quantiles(gaps, ["g"], "v", [0.5], ["m"]).count() == 0


def test_profiles_skip_nan(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "v double")
    row = stats.profile(df, ["v"]).first()
    assert (row["n"], row["n_missing"], row["mean"], row["median"], row["max"]) == (2, 2, 2.0, 2.0, 3.0)
    row = stats.summary_table(df, ["v"]).first()
    assert (row["min"], row["mean"], row["max"]) == (1.0, 2.0, 3.0)
    row = stats.box_stats(df.selectExpr("1 AS g", "v"), ["g"], "v").first()
    assert (row["n"], row["median"], row["upper"]) == (2, 2.0, 3.0)


def test_row_ids_and_split_do_not_depend_on_partitioning(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    ids, draws = [], []
    for n in (1, 4, 16):
        part = df.repartition(n)
        ids.append({(r["k"], r["row_id"]) for r in add_row_id(part, ["k"]).collect()})
        train, test = split_exact(part, 0.75, 1714, ["k"])
        draws.append({r["k"] for r in train.collect()})
        assert train.count() == 750 and test.count() == 250 and not draws[-1] & {r["k"] for r in test.collect()}
    assert ids[0] == ids[1] == ids[2] == {(k, k + 1) for k in range(1000)}
    assert draws[0] == draws[1] == draws[2]


def test_acf_and_pacf_across_chunks(spark):
    rng = np.random.default_rng(5)
    x = np.zeros(500)
    for t in range(1, 500):
        x[t] = 0.6 * x[t - 1] + rng.normal()
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(500), "v": x}))
    table = acf(df, "v", ["t"], 5, chunk=37).orderBy("lag").toPandas()["acf"].to_numpy()
    d = x - x.mean()
    assert np.allclose(table, [d[: 500 - l] @ d[l:] / (d @ d) for l in range(6)])
    p = pacf(acf(df, "v", ["t"], 5)).orderBy("lag").toPandas()["pacf"].to_numpy()
    r = np.array([d[: 500 - l] @ d[l:] / (d @ d) for l in range(6)])
    for k in range(1, 6):
        toeplitz = r[np.abs(np.subtract.outer(range(k), range(k)))]
        assert np.isclose(p[k - 1], np.linalg.solve(toeplitz, r[1:k + 1])[-1])


def test_within_counts_vertices_once_and_leaves_holes_out(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = [(1, 1), (3, 1), (3, 3), (1, 3)]
    rows = [("r", ring, i + 1, float(x), float(y)) for ring, pts in enumerate((square, hole)) for i, (x, y) in enumerate(pts)]
    out = spark.createDataFrame(rows, "region string, ring int, seq int, lon double, lat double")
    pts = spark.createDataFrame([(1, 0.5, 2.0), (2, 2.0, 2.0), (3, 5.0, 2.0), (4, 0.5, 1.0), (5, 3.5, 3.0), (6, -1.0, 4.0)],
                                "id int, x double, y double")
    assert {r["id"] for r in G.within(pts, out).collect()} == {1, 4, 5}


def test_utm_known_points(spark):
    row = spark.createDataFrame([(3.0, 0.0, 4.0, 41.0, 2.0)], "a double, b double, c double, d double, e double")
    x0, y0 = G.to_utm("a", "b")
    xe, ye = G.to_utm("c", "d")
    xw, yw = G.to_utm("e", "d")
    r = row.select(x0, y0, xe, ye, xw, yw).first()
    assert abs(r[0] - 500000) < 1e-6 and abs(r[1]) < 1e-6
    assert abs((r[2] - 500000) + (r[4] - 500000)) < 1e-6 and abs(r[3] - r[5]) < 1e-6
    # One degree of longitude at 41 N on the ellipsoid, times the scale at the central meridian.
    assert abs((r[2] - 500000) / (0.9996 * 84137.0) - 1) < 2e-3


def test_merge_conflicts_overwrites_with_null_and_drops_donors(spark):
    df = spark.createDataFrame([(1, "urban", 5.0), (1, "suburban", 9.0), (2, "urban", 5.0), (2, "suburban", None), (3, "urban", 1.0),
                                (4, None, 2.0)], "k int, area string, v double")
    got = merge_conflicts(df, ["k"], F.col("area") == "suburban", F.col("area") == "urban", "v", ["area"])
    assert {tuple(r) for r in got.collect()} == {(1, "urban", 9.0), (2, "urban", None), (3, "urban", 1.0), (4, None, 2.0)}
    assert exclude(df, df.filter("k = 1"), ["k"]).count() == 4


def test_profile_and_contingency(spark):
    df = spark.createDataFrame([(1.0, "a", "x"), (None, "a", None), (3.0, "b", "y")], "v double, g string, h string")
    p = profile(df, ["v"]).first()
    assert (p["n"], p["n_missing"], p["mean"], p["median"]) == (2, 1, 2.0, 2.0)
    assert {tuple(r) for r in contingency(df, "g", "h", ["x", "y"]).collect()} == {("a", 1, 0), ("b", 0, 1)}


def test_stage_is_built_once(spark, tmp_path):
    calls = []
    for _ in range(2):
        df = materialise(spark, str(tmp_path / "s"), lambda: calls.append(1) or spark.range(5).toDF("a"))
    assert df.count() == 5 and len(calls) == 1
    assert scratch_root(spark)


def test_no_python_and_no_cartesian_in_the_flagship_plan(spark, sf):
    from simplexspark.plans.aggregates import monthly_coordinates

    plan = monthly_coordinates(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "CartesianProduct", "NestedLoop"))
    assert "ReadSchema" not in plan or "l_tax" not in plan


def test_outline_with_a_gap_in_its_numbers(spark):
    from simplexspark.operators import geometry as G

    corners = [("a", 0, 1, 0.0, 0.0), ("a", 0, 2, 4.0, 0.0), ("a", 0, 4, 4.0, 4.0), ("a", 0, 9, 0.0, 4.0),
               ("a", 1, 3, 1.0, 1.0), ("a", 1, 7, 2.0, 1.0), ("a", 1, 8, 2.0, 2.0), ("a", 1, 20, 1.0, 2.0)]
    outline = spark.createDataFrame(corners, "region string, ring int, seq int, lon double, lat double")
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 5.0, 3.0), (3, 1.5, 1.5), (4, 0.5, 1.5)], "id int, x double, y double")
    assert G.edges(outline).count() == 8
    assert {r["id"] for r in G.within(points, outline).collect()} == {1, 4}


def test_zero_parts_are_missing_everywhere(spark):
    from simplexspark.operators import impute
    from simplexspark.operators.reshape import min_observed
    from simplexspark.operators.stats import flag_imputed

    rows = [(1, 1.4, 0.0, None), (2, 1.0, 0.0, 2.0), *[(i, 1.0, 1.0 + i / 10, 2.0) for i in range(3, 9)]]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    kept = min_observed(df, ["a", "b", "c"], 2)
    assert {r["id"] for r in kept.collect()} == set(range(2, 9))
    filled = {r["id"]: r for r in impute.impute_knn(kept, ["a", "b", "c"], ["id"], 3).collect()}
    assert filled[2]["b_imputed"] and filled[2]["b"] > 0 and not filled[3]["b_imputed"]
    origin = {(r["id"], r["part"]): r["origin"] for r in flag_imputed(kept, ["id"], ["a", "b", "c"]).collect()}
    assert origin[2, "b"] == "Imputed" and origin[2, "a"] == origin[3, "b"] == "Original"
