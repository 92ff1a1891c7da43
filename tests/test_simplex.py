"""Invariants of the log-ratio operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from simplexspark.functions import simplex as X
from simplexspark.operators import composition as C


@pytest.fixture(scope="module")
def comps(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(np.exp(rng.normal(size=(300, 6)) @ np.diag([1, .5, .7, 1.2, .3, 2])), columns=X.AIR_PARTS)
    pdf["id"] = np.arange(300)
    return spark.createDataFrame(pdf), pdf


def test_basis_is_orthonormal_and_balances_the_parts():
    v = X.basis_matrix(X.sbp_basis(X.AIR_SIGNS), X.AIR_PARTS)
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-12) and np.allclose(v.sum(axis=0), 0)
    with pytest.raises(ValueError):
        X.sbp_basis({"a": {"x": 1, "y": -1}, "b": {"x": 1, "z": -1}})


def test_closure_clr_and_round_trip(comps):
    df, pdf = comps
    closed = df.select("id", *[c.alias(p) for p, c in X.closure(X.AIR_PARTS).items()]).orderBy("id").toPandas()
    assert np.allclose(closed[X.AIR_PARTS].sum(axis=1), 1)
    clr = df.select(*[c.alias(p) for p, c in X.clr(X.AIR_PARTS).items()]).toPandas()
    assert np.allclose(clr.sum(axis=1), 0)
    z = X.to_tspace(df, X.AIR_PARTS, X.AIR_SIGNS, None)
    back = z.select("id", *[c.alias(p) for p, c in X.from_balances(X.AIR_PARTS, X.AIR_SIGNS).items()]).orderBy("id").toPandas()
    assert np.allclose(back[X.AIR_PARTS], closed[X.AIR_PARTS])


def test_coordinates_ignore_scale_but_total_does_not(comps):
    df, _ = comps
    big = df.select("id", *[(F.col(p) * 10).alias(p) for p in X.AIR_PARTS])
    a, b = (X.to_tspace(d, X.AIR_PARTS, X.AIR_SIGNS).orderBy("id").toPandas() for d in (df, big))
    assert np.allclose(a[list(X.AIR_SIGNS)], b[list(X.AIR_SIGNS)])
    assert np.allclose(b["Total"] - a["Total"], np.sqrt(6) * np.log(10))


def test_aitchison_equals_distance_of_balances(comps):
    df, _ = comps
    other = df.select(((F.col("id") + 1) % 300).alias("id"), *[F.col(p).alias(f"o_{p}") for p in X.AIR_PARTS])
    d = X.aitchison({p: F.col(p) for p in X.AIR_PARTS}, {p: F.col(f"o_{p}") for p in X.AIR_PARTS})
    got = df.join(other, "id").select("id", d.alias("d")).orderBy("id").toPandas()["d"]
    z = X.to_tspace(df, X.AIR_PARTS, X.AIR_SIGNS, None).orderBy("id").toPandas()[list(X.AIR_SIGNS)].to_numpy()
    assert np.allclose(got, np.linalg.norm(z - np.roll(z, 1, axis=0), axis=1))


def test_zero_part_is_missing_or_an_error(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "a double, b double")
    assert df.select(X.clr(["a", "b"])["a"].alias("x")).first()[0] is None
    with pytest.raises(Exception, match="positive"):
        df.select(X.clr(["a", "b"], "error")["a"].alias("x")).collect()


def test_variation_matrix_and_components(comps):
    df, pdf = comps
    v = C.variation_matrix(df, X.AIR_PARTS).toPandas()
    clr = np.log(pdf[X.AIR_PARTS]).to_numpy()
    clr = clr - clr.mean(axis=1, keepdims=True)
    assert np.isclose(v["value"].sum() / 12, clr.var(axis=0, ddof=1).sum())
    pca = C.clr_pca(df, X.AIR_PARTS)
    assert np.isclose(pca.variances.sum(), clr.var(axis=0).sum()) and pca.variances[-1] < 1e-12
    scores = pca.scores(df, ["id"]).toPandas()[[f"pc{i}" for i in range(1, 7)]]
    assert np.allclose(scores.var(ddof=0), pca.variances, atol=1e-9)
    mean, cov = C.moments(df, X.AIR_PARTS)
    mean2, cov2 = C.centred_moments(df, X.AIR_PARTS, mean + 1, np.sqrt(np.diag(cov)))
    assert np.allclose(mean, mean2) and np.allclose(cov, cov2)
