"""Nearest neighbours over cells against brute force: many levels, weights, several roots, ties, coincident points, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexspark.operators.cells import cell_knn, distances, near_pairs, split_places


@pytest.mark.parametrize("width, leaf", [(3, 8), (24, 40), (64, 1024)])
def test_equal_to_brute_force(spark, width, leaf):
    rng = np.random.default_rng(width)
    right = rng.integers(-15, 16, (900, width)).astype(float)  # whole numbers: ties are exact
    right[:300] = right[0]  # a third at one place
    left = np.concatenate([right[290:330], rng.integers(-40, 41, (40, width)).astype(float)])
    roots, weights = ["a", "b"], [[1.0] * width, [float(i % 2) for i in range(width)]]
    side = [roots[i % 5 == 0] for i in range(len(right))]
    r = spark.createDataFrame([(i, side[i], x.tolist()) for i, x in enumerate(right)] + [(5000, "a", None), (5001, "a", [float("nan")] * width), (5002, "a", [None] * width)],
                              "rid int, root string, x array<double>")
    asks = [(i, root, i % 2, x.tolist()) for i, x in enumerate(left) for root in (roots if i % 3 else roots[:1])] + [(900, "none", 0, [0.0] * width), (901, "a", 0, None)]
    got = {}
    for row in cell_knn(spark.createDataFrame(asks, "lid int, root string, w int, x array<double>"), r, 4, width, weights, leaf).collect():
        got.setdefault(row.lid, []).append((row["rank"], row.rid, round(row.d2, 9)))
    want = {}
    for i, x in enumerate(left):
        d2 = [(sum(w * (a - b) ** 2 for w, a, b in zip(weights[i % 2], x, y)), j) for j, y in enumerate(right) if i % 3 or side[j] == "a"]
        d2 = sorted((round(float(d), 9), j) for d, j in d2)
        want[i] = [(n + 1, j, d) for n, (d, j) in enumerate(d2[:4])]
    assert {i: sorted(v) for i, v in got.items()} == want
    assert cell_knn(spark.createDataFrame(asks[:3], "lid int, root string, w int, x array<double>"), r.limit(0), 4, width, weights, leaf).count() == 0


def test_vectors_built_without_nulls(spark):
    """Arrays of a query's own columns hold no nulls by type; crowded cells hand them on as their results declare them."""
    points = spark.createDataFrame([(i, i % 2, i * 37 % 101 + 0.0, i * 61 % 103 + 0.0) for i in range(300)], "n long, side int, a double, b double")
    points = points.withColumns({"lid": F.struct("n", F.lit(1).alias("one")), "x": F.array(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0)))})
    ways = spark.createDataFrame([(0, 0, "p"), (1, 0, "p")], "way int, w int, root string")
    left = points.join(ways, F.col("side") == F.col("way")).select("lid", "root", "w", "x")
    assert not left.schema["x"].dataType.containsNull
    found = cell_knn(left, points.select(F.col("lid").alias("rid"), F.lit("p").alias("root"), "x"), 2, 2, leaf=200).collect()
    assert len(found) == 600
    assert all(r.lid == r.rid and r.d2 == 0.0 for r in found if r["rank"] == 1)


@pytest.mark.parametrize("shift, grow", [(0.0, 1.0), (1e9, 1.0), (0.0, 1e160), (0.0, float("inf"))])
def test_product_leaves_no_near_pair_out(shift, grow):
    rng = np.random.default_rng(5)
    a, b = rng.integers(-3, 4, (40, 24)) + shift, rng.integers(-3, 4, (200, 24)) + shift
    a[0, 1], b[7, 2] = a[0, 1] * grow, b[7, 2] * grow
    weights = np.array([i % 3 / 7 for i in range(24)])
    r2 = np.full(40, np.inf)
    r2[:5] = 2.0
    with np.errstate(over="ignore", invalid="ignore"):
        i, j, d2 = near_pairs(a, b, weights, 4, r2)
        exact = distances(a, b, weights)
    assert (d2 == exact[i, j]).all()
    found = set(zip(i.tolist(), j.tolist()))
    near = (exact <= np.sort(exact, axis=1)[:, 3:4]) & (exact <= r2[:, None])  # with all ties
    assert set(zip(*(v.tolist() for v in np.nonzero(near)))) <= found
    assert len(found) < 40 * 200 / 4


def test_a_cell_is_halved_no_more_than_asked():
    x = np.random.default_rng(6).normal(size=(5000, 64))
    assert len(np.unique(split_places(x[:256], x, 2))) == 4
    assert len(np.unique(split_places(x[:256], x))) == 32
