"""Windows over groups cut into chunks equal the uncut windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from statloom.operators import hotgroups as hg
from statloom.operators.crosssection import average_rank, demean_and_scale
from statloom.operators.encode import code_table
from statloom.operators.rolling import rolling, rolling_z
from statloom.operators.windows import (
    expanding,
    forward_fill,
    number_rows,
    prior_average,
    quantile_bucket,
    shifted,
    trailing_average,
)
from tests.conftest import rows


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    n = 1200
    # one entity holds two thirds of the rows, most of them in a burst; order values repeat
    entity = np.where(rng.random(n) < 0.66, 1, rng.integers(2, 40, n))
    at = np.where(rng.random(n) < 0.7, rng.integers(0, 60, n), rng.integers(0, 5000, n))
    x = rng.normal(size=n).round(3)
    y = (x * 0.4 + rng.normal(size=n)).round(3)
    pdf = pd.DataFrame({"e": entity, "t": at, "id": np.arange(n), "x": x, "y": y})
    df = spark.createDataFrame(pdf)
    df = df.withColumn("gap", F.when(F.col("id") % 3 != 0, F.col("x")))
    df = df.withColumn("e", F.when(F.col("e") != 5, F.col("e")))  # a NULL entity is a group too
    return df.cache()


BY, ORDER = ["e"], ["t", "id"]


def both(series, spark, op):
    spark.conf.set(hg.LIMIT_CONF, "1000000")
    plain = rows(op(series))
    spark.conf.set(hg.LIMIT_CONF, "60")
    try:
        assert hg.find_hot(series, BY, "t") is not None
        cut = rows(op(series))
    finally:
        spark.conf.unset(hg.LIMIT_CONF)
    assert len(plain) == len(cut)
    for a, b in zip(plain, cut):
        assert a == pytest.approx(b, abs=1e-6, nan_ok=True) if all(
            isinstance(v, (int, float)) for v in a
        ) else [v if not isinstance(v, float) else round(v, 5) for v in a] == [
            v if not isinstance(v, float) else round(v, 5) for v in b
        ]


@pytest.mark.parametrize(
    "op",
    [
        lambda d: number_rows(d, BY, ORDER, "rn"),
        lambda d: hg.running(d, BY, ORDER, sums={"s": "x", "g": "gap"}, fills={"f": "gap"}),
        lambda d: hg.running(d, BY, ORDER, sums={"s": "x"}, fills={"f": "gap"}, include_current=False),
        lambda d: prior_average(d, BY, ORDER, {"p": "x"}),
        lambda d: shifted(d, BY, ORDER, ["x"], [1, 7, 90]),
        lambda d: trailing_average(d, BY, ORDER, ["x"], 3),
        lambda d: expanding(d, BY, ORDER, means={"m": F.when(F.col("x") > 0, F.col("y"))}, ratios={"r": ("y", "x")}),
        lambda d: forward_fill(d, BY, ORDER, ["gap"]),
        lambda d: quantile_bucket(d, BY, "gap", ["id"], 4, "q"),
        lambda d: rolling(d, BY, ORDER, 20, means={"m": "x"}, stds={"s": "x"}, betas={"b": ("y", "x")}),
        lambda d: rolling(d, BY, ORDER, 130, means={"m": "x"}, stds={"s": "x"}, betas={"b": ("y", "x")}, correlations={"c": ("y", "x")}),
        lambda d: rolling(d, BY, ORDER, 90, means={"m": "gap"}, stds={"s": "gap"}, min_periods=5),
        lambda d: rolling_z(d, BY, ORDER, "x", 30),
        lambda d: average_rank(d, ["e"], "x"),
        lambda d: demean_and_scale(d, ["e"], "x"),
    ],
)
def test_cut_windows_equal_plain_windows(series, spark, op):
    both(series, spark, op)


@pytest.mark.parametrize("column", ["word", "flag"])
def test_order_of_any_type_works_above_the_limit(series, spark, column):
    d = series.withColumns({"word": F.concat(F.lit("w"), F.col("t").cast("string")), "flag": F.col("t") > 30})
    both(d, spark, lambda d: number_rows(d, BY, [column, "id"], "rn"))
    both(d, spark, lambda d: shifted(d, BY, [column, "id"], ["x"], [1, 7, 90]))


def test_text_levels_above_the_limit_get_codes(spark):
    spark.conf.set(hg.LIMIT_CONF, "50")
    try:
        words = spark.range(300).select(F.format_string("w%03d", "id").alias("w"))
        got = {r["value"]: r["code"] for r in code_table(words, "w").collect()}
    finally:
        spark.conf.unset(hg.LIMIT_CONF)
    assert got == {f"w{k:03}": k for k in range(300)}


def test_running_over_everything(series, spark):
    spark.conf.set(hg.LIMIT_CONF, "100")
    try:
        got = hg.running(series, [], ORDER, sums={"s": "x"})
        w = Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
        want = series.withColumn("s", F.sum("x").over(w))
        a, b = rows(got.select("id", "s")), rows(want.select("id", "s"))
        assert len(a) == len(b) and all(u == pytest.approx(v, abs=1e-9) for u, v in zip(a, b))
    finally:
        spark.conf.unset(hg.LIMIT_CONF)


def test_prefix_sums_equal_frames(series):
    """Widths above and below the switch give what Spark's own sliding frame gives."""
    for size in (10, 100):
        w = Window.partitionBy(*BY).orderBy(*ORDER).rowsBetween(-(size - 1), 0)
        want = series.withColumn("b", F.when(F.count("x").over(w) == size, F.covar_samp("y", "x").over(w) / F.var_samp("x").over(w)))
        got = rolling(series, BY, ORDER, size, betas={"b": ("y", "x")})
        a = {r["id"]: r["b"] for r in got.collect()}
        for r in want.collect():
            assert a[r["id"]] == pytest.approx(r["b"], abs=1e-9)


@pytest.mark.parametrize("cells", [1, 4096])
def test_groups_at_the_limit_are_not_large(spark, monkeypatch, cells):
    monkeypatch.setattr(hg, "CELLS", cells)
    df = spark.range(60).select(F.when(F.col("id") % 12 > 0, F.col("id") % 12).alias("e"), "id")
    assert hg.find_hot(df, ["e"], "id", 5) is None and hg.find_hot_early(df, ["e"]) is None
    for more in (7, None):
        grown = df.union(spark.createDataFrame([(more, 60)], "e long, id long"))
        assert hg.find_hot(grown, ["e"], "id", 5) == hg.HotGroups(5)


def test_play_table_deals_plays_once_for_several_steps(spark):
    """Plays, first plays and seasons are dealt by what later steps join or group by."""
    from statloom.catalog import QUERIES
    from tests.conftest import SMALL

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["play_type_model_table"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # 15 exchanges before; plays and first plays read the same one when the plan runs
    assert plan.count("Exchange hashpartitioning") <= 13
