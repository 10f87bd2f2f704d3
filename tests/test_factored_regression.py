"""Least squares by merged triangular factors: near-collinear features, p values, intervals."""

import numpy as np
import pytest

from statloom.operators.regress import fit_ols, fit_ols_by_factors

# Quantiles of the Student distribution (two-sided 5 percent) from printed tables.
STUDENT_975 = {1: 12.706204736, 2: 4.302652730, 5: 2.570581836, 10: 2.228138852, 30: 2.042272456}


def frame(spark, x, y, parts=5):
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(x.shape[1])) + ", y double").repartition(parts)


def names(x):
    return [f"x{i}" for i in range(x.shape[1])]


def test_near_collinear_features(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=400) + 1000
    x = np.column_stack([a, a + rng.normal(size=400) * 1e-4, rng.normal(size=400)])
    y = 2 * x[:, 0] - 3 * x[:, 1] + 0.5 * x[:, 2] + 7 + rng.normal(size=400) * 1e-6
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    df = frame(spark, x, y)
    fit = fit_ols_by_factors(df, "y", names(x))
    assert fit.coefficients[1:] == pytest.approx(want[1:], rel=1e-6)
    squared = fit_ols(df, "y", names(x)).coefficients
    assert squared[2] is None or abs(squared[2] - want[2]) > 10 * abs(fit.coefficients[2] - want[2])


def test_agrees_with_the_other_fit(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.0] + rng.normal(size=300)
    df = frame(spark, x, y)
    a, b = fit_ols_by_factors(df, "y", names(x)), fit_ols(df, "y", names(x))
    assert a.coefficients == pytest.approx(b.coefficients, rel=1e-9)
    assert (a.n, a.sigma, a.r2, a.adjusted_r2) == pytest.approx((b.n, b.sigma, b.r2, b.adjusted_r2), rel=1e-9)
    assert np.allclose(a.inverse, b.inverse, rtol=1e-8, atol=1e-12)


def test_dependent_and_constant_features_have_no_coefficient(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=50)
    x = np.column_stack([a, 2 * a, np.full(50, 4.0), rng.normal(size=50)])
    fit = fit_ols_by_factors(frame(spark, x, 1 + a + x[:, 3]), "y", names(x))
    assert fit.coefficients[0] == pytest.approx(1) and fit.coefficients[1] == pytest.approx(1)
    assert fit.coefficients[2] is None and fit.coefficients[3] is None and fit.coefficients[4] == pytest.approx(1)


@pytest.mark.parametrize("free", sorted(STUDENT_975))
def test_intervals_use_tabulated_student_values(spark, free):
    n = free + 2
    x = np.arange(n, dtype=float)[:, None]
    y = 3 + 2 * x[:, 0] + np.where(np.arange(n) % 2, 1.0, -1.0)
    df = frame(spark, x, y, 2)
    fit = fit_ols_by_factors(df, "y", ["x0"])
    X = np.column_stack([np.ones(n), x])
    beta = np.linalg.solve(X.T @ X, X.T @ y)
    s = np.sqrt(((y - X @ beta) ** 2).sum() / free)
    half = STUDENT_975[free] * s * np.sqrt(np.einsum("ij,jk,ik->i", X, np.linalg.inv(X.T @ X), X))
    got = sorted((r["x0"], r["fit"], r["lwr"], r["upr"]) for r in fit.predict(df, 0.95).collect())
    for (_, f, low, high), mid, h in zip(got, X @ beta, half):
        assert (f, low, high) == pytest.approx((mid, mid - h, mid + h), rel=1e-9)


def student_two_sided(t, free):
    """By the series for whole degrees of freedom."""
    angle = np.arctan(abs(t) / np.sqrt(free))
    s, c = np.sin(angle), np.cos(angle)
    if free % 2:
        total, term = 0.0, c
        for k in range(3, free + 1, 2):
            total += term
            term *= c * c * (k - 1) / k
        return 1 - 2 / np.pi * (angle + s * total)
    total, term = 0.0, 1.0
    for k in range(2, free + 1, 2):
        total += term
        term *= c * c * (k - 1) / k
    return 1 - s * total


@pytest.mark.parametrize("n", [6, 11, 40])
def test_t_and_p_values(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 2))
    y = 0.3 * x[:, 0] + rng.normal(size=n)
    table = {r["term"]: r for r in fit_ols_by_factors(frame(spark, x, y), "y", names(x)).coefficient_table(spark).collect()}
    X = np.column_stack([np.ones(n), x])
    beta = np.linalg.solve(X.T @ X, X.T @ y)
    se = np.sqrt(((y - X @ beta) ** 2).sum() / (n - 3) * np.diag(np.linalg.inv(X.T @ X)))
    for term, b, e in zip(["(intercept)", "x0", "x1"], beta, se):
        row = table[term]
        assert (row["estimate"], row["std_error"], row["t_value"]) == pytest.approx((b, e, b / e), rel=1e-9)
        assert row["p_value"] == pytest.approx(student_two_sided(b / e, n - 3), rel=1e-9)


def test_missing_and_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (None, 3.0), (3.0, 6.0)], "x0 double, y double")
    assert fit_ols_by_factors(df, "y", ["x0"]).coefficients == pytest.approx((0.0, 2.0), abs=1e-12)
    with pytest.raises(ValueError):
        fit_ols_by_factors(df.limit(1), "y", ["x0"])
    with pytest.raises(ValueError):
        fit_ols_by_factors(df.limit(0), "y", ["x0"])
