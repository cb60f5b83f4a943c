"""Joins by position against all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from skyframe.operators import kernels, spatial


def separations(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    ra, da, rb, db = (np.radians(v.to_numpy()) for v in (a.ra, a.dec, b.ra, b.dec))
    c = np.sin(da)[:, None] * np.sin(db) + np.cos(da)[:, None] * np.cos(db) * np.cos(ra[:, None] - rb)
    return np.degrees(np.arccos(np.clip(c, -1, 1)))


@pytest.mark.parametrize("radius", [0.7, 5.0, 40.0, 90.0])
def test_cones_find_all_pairs_of_the_sphere(spark, radius):
    rng = np.random.default_rng(int(radius * 10))
    rows = pd.DataFrame({"id": range(400), "ra": rng.uniform(-360, 720, 400), "dec": np.concatenate([rng.uniform(-90, 90, 300), rng.uniform(85, 90, 50), rng.uniform(-90, -85, 50)])})
    targets = pd.DataFrame({"target": range(14), "ra": [0.0, 359.9, 0.1, 180, 90, 200, 10, 359.99, 270, 30, 60, 120, 240, 300], "dec": [0.0, 0, 5, 89.9, -89.5, 90, -90, 45, 87, -60, 60, 20, -20, 80]})
    got = spatial.cones(spark.createDataFrame(rows), spark.createDataFrame(targets), radius, "id").toPandas()
    expected = separations(rows, targets) <= radius
    assert len(got) == len(got.drop_duplicates(["id", "target"]))
    assert set(zip(got.id, got.target)) == set(zip(*np.nonzero(expected)))
    best = spatial.nearest_on_sky(spark.createDataFrame(rows), spark.createDataFrame(targets), "id", radius).toPandas().set_index("target")
    assert np.allclose(best.separation.sort_index(), separations(rows, targets).min(0), atol=1e-5) and len(best) == 14


def test_nearest_rows_of_the_other_side_of_the_sky(spark):
    rows = spark.createDataFrame([(1, 180.0, -45.0), (2, 180.0, -45.0)], "id long, ra double, dec double")
    targets = spark.createDataFrame([(7, 0.0, 45.0)], "target long, ra double, dec double")
    assert [(r.target, r.id, round(r.separation)) for r in spatial.nearest_on_sky(rows, targets, "id", 1.0).collect()] == [(7, 1, 180)]
    assert spatial.nearest_on_sky(rows.where("false"), targets, "id", 1.0).count() == 0


@pytest.mark.parametrize("few", [spatial.FEW, 0])
def test_nearest_in_the_plane(spark, monkeypatch, few):
    monkeypatch.setattr(spatial, "FEW", few)
    rng = np.random.default_rng(3)
    left = [(i, *map(float, p)) for i, p in enumerate(np.round(rng.uniform(-50, 50, (150, 2))))] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 4000.0, 0.0)]
    right = [(i, *map(float, p)) for i, p in enumerate(np.round(rng.uniform(-20, 20, (40, 2))))]
    got = spatial.nearest(spark.createDataFrame(left, "k long, x double, y double"), spark.createDataFrame(right, "o long, u double, v double"), "k", "o", ("x", "y"), ("u", "v"), 1.0).collect()
    by = {r.k: (r.o, r.distance) for r in got}
    assert set(by) == set(range(150)) | {902}
    for k, x, y in left:
        if k in by:
            distance, o = min((np.hypot(x - u, y - v), o) for o, u, v in right)
            assert by[k][0] == o and abs(by[k][1] - distance) < 1e-9


def test_splines_and_tabled_mixtures():
    x = np.array([0.0, 0.5, 1.25, 2.0, 3.0])
    cubic = lambda t: 2 - t + 3 * t**2 - 0.5 * t**3
    assert all(abs(kernels.spline(x, cubic(x), t) - cubic(t)) < 1e-9 for t in (0.0, 0.2, 0.5, 1.7, 3.0))
    assert abs(kernels.spline(x[:2], cubic(x[:2]), 0.25) - cubic(x[:2]).mean()) < 1e-9
    table = [([0.5, 0.75, 1.0], [[1, 2, 3]], [[0, 0, 0]]), ([1.0, 2.0, 3.0, 4.0], [[1, 2, 3, 4], [3, 2, 1, 0]], [[0, 1, 2, 3], [-1, -1, -1, -1]])]
    assert kernels.tabled_mixture(0.1, table) == [(1.0, 1.0)]
    mixture = np.array(kernels.tabled_mixture(2.5, table, core=0.1, beyond=0.02))
    assert np.allclose(mixture, [[0.88 * 2.5 / 4, np.exp(1.5)], [0.88 * 1.5 / 4, np.exp(-1)], [0.1, 0]])
