"""Partial dependence from leaf counts equals the average over rows x points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import learn
from statloom.operators.dependence import grid_points, leaves_of, partial_dependences

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=400), rng.integers(0, 4, size=400).astype(float)
    c = a + rng.normal(size=400)  # depends on a, where a walk by coverage alone would be wrong
    y = ((a + b > 1.5) ^ (rng.random(400) < 0.1)).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y)], "a double, b double, c double, label double")
    return learn.assemble(df, NAMES)


def by_point(df):
    return {(r["feature"], r["point"]): r[2] for r in df.collect()}


def test_forest_matches_average_over_rows(rows):
    model = learn.forest(12, 5).fit(rows)
    points = {f: [-1.0, 0.0, 0.4, 1.0, 2.0, 9.0] for f in NAMES}
    got = by_point(partial_dependences(model, rows, NAMES, points))
    for f in NAMES:
        want = by_point(learn.partial_dependence(model, rows, NAMES, f, points[f]))
        assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-9)


def test_boosted_margin_matches_average_over_rows(rows):
    model = learn.boosted_trees(5, 3).fit(rows)
    x = np.array([r["features"].toArray() for r in rows.select("features").collect()])

    def margin(x):
        total = np.zeros(len(x))
        for leaf in leaves_of(model, rows):
            inside = np.ones(len(x), bool)
            for j, (low, high) in leaf.intervals.items():
                inside &= (x[:, j] > low) & (x[:, j] <= high)
            total += inside * leaf.value
        return total

    # the leaves reproduce the model itself
    raw = np.array([r["rawPrediction"][1] for r in model.transform(rows).select("rawPrediction").collect()])
    assert np.allclose(margin(x), raw)
    got = by_point(partial_dependences(model, rows, NAMES, {"a": [-0.5, 0.5], "b": [2.0]}))
    for (f, p), v in got.items():
        moved = x.copy()
        moved[:, NAMES.index(f)] = p
        assert v == pytest.approx(margin(moved).mean(), abs=1e-9)


def test_points(rows):
    points = grid_points(rows, NAMES, resolution=20)
    assert points["b"] == [0.0, 1.0, 2.0, 3.0]
    a = sorted(r["a"] for r in rows.select("a").collect())
    assert len(points["a"]) == 20
    assert points["a"][0] == pytest.approx(np.quantile(a, 0.05)) and points["a"][-1] == pytest.approx(np.quantile(a, 0.95))


def test_no_rows(rows):
    model = learn.forest(2, 2).fit(rows)
    assert partial_dependences(model, rows.where(F.lit(False)), NAMES, {"a": [0.0]}).collect() == []


def test_one_pass_whatever_the_points(rows):
    """The rows are read by one job for the counts; points only weigh them."""
    model = learn.forest(3, 3).fit(rows)
    assert partial_dependences(model, rows, NAMES, {"a": np.linspace(-3, 3, 5000)}).count() == 5000
