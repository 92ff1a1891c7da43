"""Fixed effects of numbers and categories against dense generalised least squares."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from simplexspark.operators import surface as M
from simplexspark.operators.factors import fit_factors


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    n = 900
    pdf = pd.DataFrame({"g": rng.integers(0, 40, n), "a": rng.normal(50, 9, n), "b": rng.normal(-3, 2, n),
                        "kind": rng.choice(["low", "mid", "top"], n, p=[0.6, 0.3, 0.1]), "zone": rng.choice(["e", "w"], n)})
    u = rng.normal(0, 2, 40)
    pdf["y"] = (3 + 0.2 * pdf.a - pdf.b + pdf.kind.map({"low": 0, "mid": 4, "top": -6}) + np.where(pdf.kind == "top", 0.3 * pdf.a, 0)
                + np.where(pdf.zone == "w", 1.5, 0) + u[pdf.g] + rng.normal(0, 1, n))
    pdf["z"] = np.where(rng.random(n) < 0.2, np.nan, pdf.y * 2 + rng.normal(0, 1, n))
    return pdf


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("y", "z")}).repartition(5)


def design(pdf):
    cols = {"intercept": np.ones(len(pdf)), "a": pdf.a, "b": pdf.b}
    for v in ("mid", "top"):
        cols[f"kind={v}"] = (pdf.kind == v) * 1.0
        cols[f"a:kind={v}"] = (pdf.kind == v) * pdf.a
    cols["zone=w"] = (pdf.zone == "w") * 1.0
    return pd.DataFrame(cols)


def test_matches_dense_generalised_least_squares(spark, rows):
    df = frame(spark, rows)
    fits, effects = fit_factors(df, ["y", "z"], ["a", "b"], "g", ["kind", "zone"], {"kind": ["a"]}, tol=1e-10)
    got_effects = effects.toPandas().set_index("g")
    for y in ("y", "z"):
        own, fit = rows.dropna(subset=[y]), fits[y]
        x = design(own)
        v = fit.sigma_e2 * np.eye(len(own)) + fit.sigma_u2 * (own.g.values[:, None] == own.g.values[None, :])
        w = np.linalg.inv(v)
        cov = np.linalg.inv(x.values.T @ w @ x.values)
        beta = cov @ x.values.T @ w @ own[y].values
        t = fit.table(spark).toPandas().set_index("term").loc[list(x.columns)]
        assert np.allclose(t["mean"], beta, rtol=1e-6, atol=1e-6) and np.allclose(t["sd"], np.sqrt(np.diag(cov)), rtol=1e-6)
        assert fit.n == len(own) and abs(fit.sigma_u2 - (4 if y == "y" else 16)) < (2.5 if y == "y" else 10)
        rest = pd.Series(own[y].values - x.values @ beta).groupby(own.g.values).agg(["sum", "size"])
        want = rest["sum"] * fit.sigma_u2 / (fit.sigma_e2 + rest["size"] * fit.sigma_u2)
        assert np.allclose(got_effects[f"u_{y}"].loc[want.index], want, atol=1e-6)
    out = df.select("a", "b", "kind", "zone", fits["y"].fixed_mean().alias("m"), fits["y"].fixed_var().alias("v"))
    got = out.toPandas()
    x = design(got).values
    fit = fits["y"]
    t = fit.table(spark).toPandas().set_index("term").loc[list(design(got).columns)]
    assert np.allclose(got.m, x @ t["mean"].values, atol=1e-6)
    own = rows
    v = fit.sigma_e2 * np.eye(len(own)) + fit.sigma_u2 * (own.g.values[:, None] == own.g.values[None, :])
    xx = design(own).values
    cov = np.linalg.inv(xx.T @ np.linalg.inv(v) @ xx)
    assert np.allclose(got.v, np.einsum("ij,jk,ik->i", x, cov, x), rtol=1e-6)
    both = M.with_effects(df, fits, effects, "g").agg(F.count("fixed_z"), F.count("var_z"), F.count("u_z")).first()
    assert tuple(both) == (900, 900, 900)


def test_without_factors_it_is_the_plain_fit(spark, rows):
    df = frame(spark, rows)
    plain, _ = M.fit_many(df, ["z"], ["a", "b"], "g")
    fits, _ = fit_factors(df, ["z"], ["a", "b"], "g", [])
    assert np.allclose(fits["z"].beta, plain["z"].beta) and np.allclose(fits["z"].cov, plain["z"].cov)
    assert np.isclose(fits["z"].sigma_u2, plain["z"].sigma_u2)


def test_edges(spark, rows):
    df = frame(spark, rows)
    odd = df.unionByName(df.limit(5).withColumns({"kind": F.lit(None).cast("string")})).withColumn("r", F.lit("extra")).withColumn("s", F.lit(1))
    fits, _ = fit_factors(odd, ["y"], ["a"], "g", ["kind"])
    assert fits["y"].n == 900
    unseen = df.limit(1).withColumn("kind", F.lit("new")).select(fits["y"].fixed_mean().alias("m")).first()
    assert unseen.m is None
    with pytest.raises(ValueError, match="levels"):
        fit_factors(df, ["y"], ["a"], "g", ["kind"], max_levels=2)
    with pytest.raises(ValueError, match="no row"):
        fit_factors(df.limit(0), ["y"], ["a"], "g", ["kind"])
    hot = frame(spark, pd.concat([rows, rows[rows.g == 1].sample(2000, replace=True, random_state=1)], ignore_index=True))
    assert np.isfinite(fit_factors(hot, ["y"], ["a"], "g", ["kind", "zone"])[0]["y"].beta).all()
