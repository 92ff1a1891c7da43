"""Kriging of a large batch: as many numbers in memory as a slice of it needs, the same results."""

import tracemalloc

import numpy as np
import pandas as pd

from simplexspark.operators import surface


def test_a_batch_is_kriged_in_slices():
    rng = np.random.default_rng(3)
    n, width = 5001, 18
    lists = {c: list(rng.normal(size=(n, width))) for c in ("nx", "ny", "n0", "n1")}
    rows = pd.DataFrame({"id": range(n), "x": rng.normal(size=n), "y": rng.normal(size=n), **lists, "dt": list(rng.integers(-1, 2, (n, width)).astype(float))})
    rows.loc[7, ["nx", "ny", "dt", "n0", "n1"]] = None
    models = [surface.FieldModel(2.0, 0.5, 0.7, 0.4), surface.FieldModel(1.0, 0.1, 0.2, 0.0)]
    curve_t = np.concatenate([[0.0], np.geomspace(1e-4, 60.0, 400)])
    how = ("id", ["a", "b"], models, curve_t, surface.matern1(curve_t))
    tracemalloc.start()
    got = pd.concat(list(surface._in_slices(iter([rows]), *how)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # one go takes more than 100 MB
    pd.testing.assert_frame_equal(got, surface._krige(rows, *how))
