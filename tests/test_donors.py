"""Donors found over many cells against brute force, and what the search leaves on disk."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexspark.operators import donors as D
from simplexspark.operators import impute
from simplexspark.sources.stages import scratch_root


def brute(x, k):
    """Fill and number of donors of every missing cell, ties to the smaller row number."""
    out, seen = {}, x > 0
    for i in range(len(x)):
        own = np.flatnonzero(seen[i])
        for j in np.flatnonzero(~seen[i]) if len(own) >= 2 else []:
            ok = np.flatnonzero(seen[:, [*own, j]].all(axis=1))
            if len(ok):
                a = np.repeat(x[i:i + 1], len(ok), axis=0)
                best = ok[np.lexsort((ok, D.aitchison2(a, x[ok], own.tolist())))][:k]
                out[i, int(j)] = (np.median(x[best, j] / np.median(x[best][:, own], axis=1)) * np.median(x[i, own]), len(best))
    return out


@pytest.mark.parametrize("cell, takers", [(60, 25), (1 << 18, 1 << 18)])
def test_cells_equal_brute_force(spark, monkeypatch, cell, takers):
    monkeypatch.setattr(D, "CELL", cell)
    monkeypatch.setattr(D, "TAKERS", takers)
    rng = np.random.default_rng(31)
    x = np.exp(rng.normal(size=(1100, 6)) * 0.4 + 2)
    x[:300] = x[0]  # more than a leaf at one place
    x[300:500] = np.exp(rng.integers(0, 3, (200, 6)))  # ties
    x[rng.random(x.shape) < 0.3] = np.nan
    x[rng.random(len(x)) < 0.97, 5] = np.nan  # a part that few rows have
    x[7, 1], x[8, 2], x[9, 3] = 0.0, -1.0, np.nan
    rows = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, " + ", ".join(f"p{i} double" for i in range(6)))
    got = impute.knn_candidates(rows.repartition(5), [f"p{i}" for i in range(6)], ["id"], 4).collect()
    want = brute(np.nan_to_num(x), 4)
    assert {(r["__row"]["id"], r["j"]): r["donors"] for r in got} == {c: n for c, (_, n) in want.items()}
    for r in got:
        assert np.isclose(r["value"], want[r["__row"]["id"], r["j"]][0], rtol=1e-12)
    plan = D.planned({m: 10 * (m.bit_count() + 1) for m in range(64)}, 6, np.nan_to_num(x))
    assert (max(len(c.low) for c in plan) > 3) == (cell == 60)


def test_a_fill_writes_little_beside_its_rows(spark):
    parts = [f"p{i}" for i in range(5)]
    gaps = [F.when(F.rand(i) > 0.3, F.exp(F.randn(50 + i))).alias(p) for i, p in enumerate(parts)]
    df = spark.range(16000).select("id", *gaps).where(sum((F.col(p).isNotNull().cast("int") for p in parts), F.lit(0)) >= 2)
    before = written(spark)
    assert impute.impute_knn(df, parts, ["id"], 5).where(F.greatest(*[F.col(p).isNull() for p in parts])).count() == 0
    assert written(spark) - before < 16000 * 90  # the walk of the trees wrote 197 bytes a row


def written(spark):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(scratch_root(spark)) for f in files)


def test_shuffles_go_with_the_cut(spark):
    from simplexspark.sources import cut
    from simplexspark.sources.stages import CLEANUP

    was = spark.conf.get(CLEANUP)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    frame = spark.range(1000).repartition(3, "id").groupBy("id").count()
    known = tracker.shuffleStatuses().size()
    assert cut(frame).count() == 1000
    assert tracker.shuffleStatuses().size() <= known + 1  # that of the count
    assert spark.conf.get(CLEANUP) == was and frame.count() == 1000
