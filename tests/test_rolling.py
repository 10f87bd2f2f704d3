"""Rolling statistics at any width against direct computation."""

import numpy as np
import pytest

from statloom.operators.rolling import rolling, rolling_zs


def direct(values, other, w, need):
    out = []
    for i in range(len(values)):
        pair = [(a, b) for a, b in zip(values[max(0, i - w + 1) : i + 1], other[max(0, i - w + 1) : i + 1]) if a is not None and b is not None]
        y, x = np.array([p[0] for p in pair]), np.array([p[1] for p in pair])
        if len(y) < max(need, 2):
            out.append((None, None, None))
            continue
        xx, yy, xy = ((x - x.mean()) ** 2).sum(), ((y - y.mean()) ** 2).sum(), ((x - x.mean()) * (y - y.mean())).sum()
        out.append((np.sqrt(yy / (len(y) - 1)), xy / xx if xx else None, xy / np.sqrt(xx * yy) if xx * yy else None))
    return out


@pytest.mark.parametrize("width", [1, 2, 7, 64, 65, 200])
def test_large_values_leave_the_window(spark, width):
    rng = np.random.default_rng(4)
    values = [*(1e4 * rng.normal(size=100)), *(1e-4 * rng.normal(size=300))]
    other = list(rng.normal(size=400))
    values[350], other[120] = None, None
    rows = [(0, t, None if v is None else float(v), None if o is None else float(o)) for t, (v, o) in enumerate(zip(values, other))]
    df = spark.createDataFrame(rows, "g int, t int, y double, x double")
    got = rolling(df, ["g"], ["t"], width, betas={"b": ("y", "x")}, correlations={"c": ("y", "x")}, min_periods=1).orderBy("t").collect()
    for row, (_, beta, corr) in zip(got, direct(values, other, width, 1)):
        assert row["b"] == (beta if beta is None else pytest.approx(beta, rel=1e-9, abs=1e-18))
        assert row["c"] == (corr if corr is None else pytest.approx(corr, rel=1e-9, abs=1e-15))
    spread = rolling(df, ["g"], ["t"], width, stds={"s": "y"}, min_periods=1).orderBy("t").collect()
    for row, (std, _, _) in zip(spread, direct(values, values, width, 1)):
        assert row["s"] == (std if std is None else pytest.approx(std, rel=1e-9))


def test_z_scores_of_a_small_tail(spark):
    values = [1e4 * (-1) ** t for t in range(100)] + [1e-4 * (-1) ** t for t in range(300)]
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate(values)], "g int, t int, v double")
    row = rolling_zs(df, ["g"], ["t"], "v", [64, 65, 200]).orderBy("t").collect()[-1]
    for width in (64, 65, 200):
        window = np.array(values[-width:])
        assert row[f"z_{width}"] == pytest.approx((window[-1] - window.mean()) / window.std(ddof=1))
