"""Planted truth for imputation, robust fits and the surface model."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from simplexspark.operators import impute, robust
from simplexspark.operators import surface as M
from simplexspark.plans.base import PARTS, SIGNS


def test_chi2_quantiles():
    for p, k, want in ((0.95, 1, 3.841459), (0.975, 5, 12.832502), (0.5, 2, 1.386294), (0.999999, 2, 27.631021)):
        assert abs(robust.chi2_quantile(p, k) / want - 1) < 1e-3


def test_lts_resists_a_third_of_bad_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + 0.05 * rng.normal(size=600)
    y[:200] += 30
    x[:200, 0] += 4
    fit = robust.lts_fit(spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1]})), "y", ["a", "b"])
    assert np.allclose(fit, [1, 2, -1], atol=0.05)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    n = 500
    from simplexspark.functions import simplex as X
    v = X.basis_matrix(X.sbp_basis(SIGNS), PARTS)
    z = rng.multivariate_normal(np.zeros(5), 0.04 * (np.eye(5) + 0.3), size=n)
    p = np.exp(z @ v.T)
    for i in range(12):
        p[i, i % 6] *= 50
    pdf = pd.DataFrame(p, columns=PARTS)
    pdf["id"] = np.arange(n)
    return pdf


def test_outlier_screen_finds_the_planted_parts(spark, planted):
    df = spark.createDataFrame(planted)
    model = robust.fit_outliers(df, PARTS, SIGNS)
    got = robust.flag_outliers(df, model).toPandas().set_index("id")
    assert (got.loc[:11, "outlier"] == "Outlier").all()
    assert got.loc[12:, "outlier_bin"].mean() < 0.01
    for i in range(12):
        assert got.loc[i, "outlier_cause"] == PARTS[i % 6]


def test_concentration_equals_numpy_for_all_starts(spark):
    rng = np.random.default_rng(21)
    x = rng.multivariate_normal([1, -2, 0], [[2, 1, 0], [1, 3, 1], [0, 1, 1]], size=4000)
    x[:1000] += [30, 0, 5]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).repartition(5)
    centre, scale = np.median(x, axis=0), np.array([2.0, 1.0, 3.0])
    starts = [robust.Start(np.zeros(3), np.eye(3)), robust.Start(np.array([1.0, 0, 0]), np.diag([1.0, 2, 3]))]
    h, u = 2002, (x - centre) / scale
    for start, got in zip(starts, robust.concentrate(df, list("abc"), h, starts, centre, scale)):
        d2 = np.einsum("ni,ij,nj->n", u - start.centre, np.linalg.inv(start.scatter), u - start.centre)
        bins = np.floor(np.log2(d2) * robust.BINS)
        last = np.sort(bins)[h - 1]
        weight = (bins < last) + (bins == last) * (h - (bins < last).sum()) / (bins == last).sum()
        assert np.isclose(weight.sum(), h)
        mean = weight @ u / h
        assert np.allclose(got.centre, mean)
        assert np.allclose(got.scatter, (u * weight[:, None]).T @ u / h - np.outer(mean, mean))


def test_location_and_scatter_withstand_a_quarter_of_far_rows(spark):
    rng = np.random.default_rng(22)
    want = np.array([[2, 1, 0], [1, 3, 1], [0, 1, 1.0]])
    x = rng.multivariate_normal([1, -2, 0], want, size=6000)
    x[:1500] = rng.normal([40, 10, -20], 0.5, (1500, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    m, s = robust.robust_location_scatter(df, list("abc"))
    assert np.allclose(m, [1, -2, 0], atol=0.15) and np.allclose(s, want, atol=0.3)
    tied = df.selectExpr("a", "b", "CASE WHEN a > 30 THEN c ELSE 1D END AS c")
    with pytest.raises(ValueError, match="constant"):
        robust.robust_location_scatter(tied, list("abc"))
    with pytest.raises(ValueError, match="few"):
        robust.robust_location_scatter(df.limit(6), list("abc"))


@pytest.mark.parametrize("d, share", [(6, 0.25), (8, 0.15)])
def test_knn_imputation_equals_brute_force(spark, d, share):
    parts = [*PARTS, "q7", "q8"][:d]
    rng = np.random.default_rng(8)
    full = np.exp(rng.normal(size=(80, d)) * 0.5 + 2)
    gaps = rng.random((80, d)) < share
    pdf = pd.DataFrame(np.where(gaps, np.nan, full), columns=parts)
    pdf["id"] = np.arange(80)
    df = spark.createDataFrame(pdf).select("id", *[F.when(~F.isnan(p), F.col(p)).alias(p) for p in parts])
    got = impute.impute_knn(df, parts, ["id"], 3).toPandas().sort_values("id")
    x = pdf[parts].to_numpy()
    for i in range(80):
        seen = ~np.isnan(x[i])
        for j in np.flatnonzero(~seen):
            if seen.sum() < 2:
                continue
            ok = [r for r in range(80) if not np.isnan(x[r, [*np.flatnonzero(seen), j]]).any()]
            l = np.log(x[i, seen]) - np.log(x[ok][:, seen])
            d2 = (l ** 2).sum(axis=1) - l.sum(axis=1) ** 2 / seen.sum()
            near = np.array(ok)[np.argsort(d2)[:3]]
            want = np.median(x[near, j] / np.median(x[near][:, seen], axis=1)) * np.median(x[i, seen])
            assert np.isclose(got[parts[j]].to_numpy()[i], want) and got[f"{parts[j]}_imputed"].to_numpy()[i]
    assert np.allclose(got[parts].to_numpy()[~gaps], x[~gaps])


@pytest.fixture(scope="module")
def gappy(spark):
    """A part that the others determine, missing in a fifth of the rows and spoilt in a tenth."""
    rng = np.random.default_rng(18)
    n = 400
    logs = rng.normal(size=(n, 6)) * 0.5 + 2
    logs[:, 0] = logs[:, 1:].mean(axis=1) + 0.3 + 0.6 * (logs[:, 1] - logs[:, 2]) - 0.4 * (logs[:, 3] - logs[:, 4]) + 0.01 * rng.normal(size=n)
    truth, gaps = logs[:, 0].copy(), np.arange(n) < 80
    logs[360:, 0] += 4
    pdf = pd.DataFrame(np.exp(logs), columns=PARTS)
    pdf["id"] = np.arange(n)
    pdf["gap"] = gaps
    df = spark.createDataFrame(pdf).withColumn(PARTS[0], F.when(~F.col("gap"), F.col(PARTS[0]))).drop("gap")
    return df, truth[:80]


def test_robust_imputation_recovers_planted_parts(gappy):
    df, truth = gappy
    got = impute.impute_robust(df, PARTS, ["id"], 5).toPandas().sort_values("id")
    error = np.log(got[PARTS[0]].to_numpy()[:80]) - truth
    assert np.abs(error).max() < 0.1 and got[f"{PARTS[0]}_imputed"].tolist() == [True] * 80 + [False] * 320
    assert np.allclose(got[PARTS[1:]].to_numpy(), df.toPandas().sort_values("id")[PARTS[1:]].to_numpy())


def test_fills_compared_are_knn_and_robust(spark, gappy, monkeypatch):
    from simplexspark.plans import composition as P

    df, truth = gappy
    monkeypatch.setattr(P, "kept", lambda *_: df)
    monkeypatch.setattr(P, "KEY", ["id"])
    before, fills = P._fills(spark, "")
    long = impute.compare_imputations(before, fills, ["id"], PARTS, close=False).filter(F.col("origin") == "Imputed").toPandas()
    error = {m: np.abs(np.log(g.sort_values("id")["value"].to_numpy()) - truth).mean() for m, g in long.groupby("method")}
    assert set(error) == {"KNN", "LTS", "GM"} and error["LTS"] < 0.05 < min(error["KNN"], error["GM"])


def test_gls_and_intercepts_recover_the_truth(spark):
    rng = np.random.default_rng(9)
    g = np.arange(4000) % 80
    u = rng.normal(0, 2, 80)
    a, t = rng.normal(300, 200, 4000), rng.normal(15, 6, 4000)
    y = 4 + 0.01 * a - 0.2 * t + u[g] + rng.normal(0, 1, 4000)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "a": a, "t": t, "y": y}))
    fits, effects = M.fit_many(df, ["y"], ["a", "t"], "g")
    table = fits["y"].table(spark).toPandas().set_index("term")["mean"]
    assert abs(table["a"] - 0.01) < 5e-4 and abs(table["t"] + 0.2) < 0.01
    assert abs(fits["y"].sigma_e2 - 1) < 0.1 and abs(fits["y"].sigma_u2 - 4) < 1.5
    got = effects.toPandas().set_index("g")["u_y"].sort_index().to_numpy()
    assert np.corrcoef(got, u)[0, 1] > 0.99


def test_matern_values():
    t = np.array([0.0, 0.5, 1.0, 2.0])
    assert np.allclose(M.matern1(t), [1.0, 0.8282206, 0.6019072, 0.2797318], atol=1e-6)


def test_kriging_is_exact_without_nugget_and_reverts_far_away(spark):
    src = spark.createDataFrame([(1, 0.0, 0.0, 5, 2.0), (2, 10.0, 0.0, 5, -1.0)], "row_id int, x double, y double, ym int, res_v double")
    to = spark.createDataFrame([(1, 0.0, 0.0, 5), (2, 1e6, 1e6, 5), (3, 0.0, 0.0, 99)], "t int, x double, y double, ym int")
    got = M.predict_field(to, src, {"v": M.FieldModel(3.0, 0.0, 0.2, 0.5)}, "t", "row_id", 2).toPandas().set_index("t")
    assert abs(got.loc[1, "f_v"] - 2) < 1e-6 and got.loc[1, "fvar_v"] < 1e-6
    for t in (2, 3):
        assert abs(got.loc[t, "f_v"]) < 1e-9 and abs(got.loc[t, "fvar_v"] - 3) < 1e-9


def test_surface_bands_cover_planted_field(spark):
    """Field with known range and AR(1) on 60 stations and 10 months."""
    rng = np.random.default_rng(10)
    xy = rng.uniform(0, 100, (60, 2))
    h = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    root = np.linalg.cholesky(M.matern1(np.sqrt(8) / 40 * h) + 1e-9 * np.eye(60))
    field = [root @ rng.normal(size=60)]
    for _ in range(9):
        field.append(0.8 * field[-1] + 0.6 * (root @ rng.normal(size=60)))
    rows = [(s * 100 + m, s, float(xy[s, 0]), float(xy[s, 1]), m, f"g{s % 12}", float(a := rng.normal()),
             float(1 + 0.5 * a + field[m][s] + 0.2 * rng.normal())) for s in range(60) for m in range(10)]
    df = spark.createDataFrame(rows, "row_id int, station int, x double, y double, ym int, g string, a double, v double")
    got = M.holdout(df, ["v"], ["a"], "g", "station", "row_id", 60.0).first()
    assert got["n"] == 150 and got["r"] > 0.8 and 0.85 <= got["coverage"] <= 1.0


def test_lts_resists_equal_bad_rows(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(1000, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + 0.05 * rng.normal(size=1000)
    x[:370], y[:370] = [3.0, -2.0], -40.0
    fit = robust.lts_fit(spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1]})), "y", ["a", "b"])
    assert np.allclose(fit, [1, 2, -1], atol=0.05)
