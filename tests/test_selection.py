"""Order statistics by cell refinement against numpy, with tiny cells so that every pass is met."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import selection
from statloom.operators.selection import quantiles, ranked_values

POINTS = [0.0, 0.05, 0.25, 0.5, 0.9, 0.95, 1.0]


@pytest.fixture
def few(spark):
    spark.conf.set(selection.FEW_CONF, "3")
    yield
    spark.conf.unset(selection.FEW_CONF)


def frame(spark, groups, kind="double"):
    rows = [(g, v) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, f"g string, x {kind}").repartition(5)


def expected(values):
    v = sorted(x for x in values if x is not None)
    out = {}
    for p in POINTS:
        at = (len(v) - 1) * p
        low, high = v[math.floor(at)], v[math.ceil(at)]
        out[p] = low + (high - low) * (at - math.floor(at))
    return out


def shapes():
    rng = np.random.default_rng(4)
    return {
        "uniform": rng.uniform(0, 1, 3000).tolist(),
        "normal": rng.normal(0, 5, 2000).tolist(),
        "wide": [float(s * 2.0**e) for e in range(-1074, 1024, 3) for s in (1, -1)],
        "near": (1 + np.arange(500) * 2.0**-52).tolist(),
        "repeated": [7.5] * 900 + [8.0] * 3,
        "outlier": rng.uniform(0, 1, 500).tolist() + [1e300, -1e300],
        "zeros": [0.0, -0.0] * 40 + [1e-320, -1e-320],
        "one": [3.0],
        "some missing": [None, 2.0, None, 1.0],
    }


@pytest.mark.parametrize("limit", ["small", "default"])
def test_grouped_quantiles(spark, request, limit):
    if limit == "small":
        request.getfixturevalue("few")
    groups = shapes() | {"none": [None], None: [1.0, 5.0]}
    got = {(r["g"], r["point"]): r["value"] for r in quantiles(frame(spark, groups), ["g"], "x", POINTS).collect()}
    want = {(g, p): v for g, values in groups.items() if g != "none" for p, v in expected(values).items()}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-14, abs=0), key


@pytest.mark.parametrize("name", ["uniform", "wide", "repeated", "one"])
def test_without_groups(spark, few, name):
    values = shapes()[name]
    got = {r["point"]: r["value"] for r in quantiles(frame(spark, {"a": values}), [], "x", POINTS).collect()}
    assert got == pytest.approx(expected(values), rel=1e-14)


def test_infinities_and_nan_sort_last(spark, few):
    values = [float("-inf")] * 5 + list(map(float, range(40))) + [float("inf")] * 5 + [float("nan")] * 5
    got = ranked_values(frame(spark, {"a": values}), [], "x", F.sequence(F.lit(0).cast("bigint"), F.col("_total") - 1)).collect()
    by_rank = [r["value"] for r in sorted(got, key=lambda r: r["rank"])]
    assert by_rank[:50] == values[:50] and all(map(math.isnan, by_rank[50:]))


def test_integers_that_share_a_double(spark, few):
    values = [2**60 + k for k in range(60)] * 2 + [5]
    ranks = F.sequence(F.lit(0).cast("bigint"), F.col("_total") - 1)
    got = ranked_values(frame(spark, {"a": values}, "long"), ["g"], "x", ranks).collect()
    assert [r["value"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(values)


def test_empty_table(spark):
    assert quantiles(frame(spark, {}), ["g"], "x", POINTS).collect() == []
    assert quantiles(frame(spark, {"a": [None]}), [], "x", POINTS).collect() == []


def test_other_column_names_do_not_clash(spark):
    df = frame(spark, {"a": [1.0, 2.0, 4.0]}).withColumns({"rank": F.lit(9), "total": F.lit(8), "at": F.lit(7)})
    assert quantiles(df, ["g", "at"], "x", [0.5]).select("g", "at", "value").first()[:] == ("a", 7, 2.0)


def test_shuffle_does_not_grow_with_distinct_values(spark):
    """The first pass leaves as many rows for a million distinct values as for a thousand."""

    def cells(n):
        x = (F.col("id") / n + 1).alias("x")
        return spark.range(n, numPartitions=4).select(x).groupBy(selection.log_cell(F.col("x"))).count().count()

    assert cells(1_000_000) == cells(1000)
