"""Correlations of wide tables against DuckDB, and their edge cases."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from statloom.operators.aggregate import correlation_matrix
from statloom.operators.gram import wide_correlations


def as_dict(df):
    return {(r["var1"], r["var2"]): r["r"] for r in df.collect()}


def duck(frame, columns):
    con = duckdb.connect()
    con.register("t", frame)
    out = {}
    for a in columns:
        row = con.execute(f"SELECT {', '.join(f'corr({a}, {b})' for b in columns)} FROM t").fetchone()
        out |= {(a, b): None if v is None or np.isnan(v) else v for b, v in zip(columns, row)}
    return out


def test_three_hundred_columns_with_missing_values(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 20))
    x = base @ rng.normal(size=(20, 300)) + rng.normal(size=(400, 300)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    columns = [f"v{i}" for i in range(300)]
    pdf = pd.DataFrame(x, columns=columns)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)
    got = as_dict(wide_correlations(df, columns))
    want = pdf.corr().to_numpy()
    assert len(got) == 90_000
    for i in range(0, 300, 7):
        for j in range(300):
            assert got[columns[i], columns[j]] == pytest.approx(want[i, j], abs=1e-9)
    some = columns[::40]
    exact = duck(pdf.astype(object).where(pdf.notna(), None).astype(float), some)
    assert {k: got[k] for k in exact} == pytest.approx(exact, abs=1e-9)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_blocks_and_expressions_agree(spark, block):
    rng = np.random.default_rng(2)
    rows = [(float(a), int(b), None if c < 0 else float(c)) for a, b, c in zip(rng.normal(size=90), rng.integers(0, 9, 90), rng.normal(size=90))]
    df = spark.createDataFrame(rows, "a double, `b b` int, c double")
    narrow = as_dict(correlation_matrix(df.withColumnRenamed("b b", "b"), ["a", "b", "c"]))
    wide = {(x.split()[0], y.split()[0]): r for (x, y), r in as_dict(wide_correlations(df, ["a", "b b", "c"], block)).items()}
    assert wide == pytest.approx(narrow, abs=1e-12)


def test_edges(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, None, 1.0, float("nan")), (2.0, 5.0, None, None, 1.0), (4.0, 5.0, 1.0, None, 2.0)],
        "a double, flat double, once double, apart double, odd double",
    )
    got = as_dict(wide_correlations(df, df.columns))
    assert got["a", "a"] == 1.0 and got["a", "flat"] is None and got["flat", "flat"] is None
    assert got["once", "apart"] is None and got["once", "once"] is None
    assert np.isnan(got["a", "odd"]) and len(got) == 25


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert set(as_dict(wide_correlations(df, ["a", "b"])).values()) == {None}
