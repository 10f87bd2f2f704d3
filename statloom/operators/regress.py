"""Ordinary least squares, from one aggregation pass or from merged triangular factors, with intervals
and residual summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.scalar import bucket_label, half_even
from statloom.operators.selection import quantiles

INTERCEPT = "(intercept)"


def _student(spark: SparkSession, df: float):
    return spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(df))


@dataclass(frozen=True)
class LinearFit:
    """Coefficients of ``target ~ 1 + features``; a feature that depends linearly on earlier ones
    has no coefficient (None)."""

    target: str
    features: tuple[str, ...]
    coefficients: tuple[float | None, ...]  # intercept first
    inverse: np.ndarray  # (X'X)^-1 over the intercept and the kept features
    n: int
    sigma: float
    r2: float
    adjusted_r2: float

    @property
    def kept(self) -> list[str]:
        return [f for f, b in zip(self.features, self.coefficients[1:]) if b is not None]

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        free = self.n - len(self.kept) - 1
        dist = _student(spark, free)
        spread = iter(self.sigma * np.sqrt(np.diag(self.inverse)))
        rows = []
        for term, b in zip((INTERCEPT, *self.features), self.coefficients):
            if b is None:
                rows.append((term, None, None, None, None))
                continue
            se = float(next(spread))
            t = b / se if se > 0 else None
            p = 2 * dist.cumulativeProbability(-abs(t)) if t is not None else None
            rows.append((term, b, se, t, p))
        return spark.createDataFrame(
            rows, "term string, estimate double, std_error double, t_value double, p_value double"
        )

    def summary_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.n, self.sigma, self.r2, self.adjusted_r2)],
            "n bigint, residual_std double, r2 double, adjusted_r2 double",
        )

    def fitted(self) -> Column:
        terms = [F.lit(self.coefficients[0])]
        terms += [F.col(f) * b for f, b in zip(self.features, self.coefficients[1:]) if b is not None]
        return reduce(lambda a, b: a + b, terms)

    def predict(self, df: DataFrame, level: float | None = None) -> DataFrame:
        """Add ``fit`` and, with a ``level``, the confidence interval of the mean as lwr/upr."""
        out = df.withColumn("fit", self.fitted())
        if level is None:
            return out
        free = self.n - len(self.kept) - 1
        t = _student(df.sparkSession, free).inverseCumulativeProbability(0.5 + level / 2)
        x = [F.lit(1.0), *[F.col(f) for f in self.kept]]
        quad = reduce(
            lambda a, b: a + b,
            [
                x[i] * x[j] * float(self.inverse[i, j] * (1 if i == j else 2))
                for i, j in combinations_with_replacement(range(len(x)), 2)
            ],
        )
        half = F.sqrt(F.greatest(quad, F.lit(0.0))) * (t * self.sigma)
        return out.withColumn("lwr", F.col("fit") - half).withColumn("upr", F.col("fit") + half)


def fit_ols(df: DataFrame, target: str, features: Sequence[str]) -> LinearFit:
    """Fit on the complete rows. Means and covariances come from one aggregation on Spark; only the
    (features + 1)^2 numbers reach the driver."""
    names = [target, *features]
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    complete = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]).dropna()
    row = complete.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(names))],
        *[F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    n = row["n"]
    if n < 2:
        raise ValueError("a linear fit needs at least two complete rows")
    mean = np.array([row[f"m{i}"] for i in range(len(names))])
    s = np.empty((len(names), len(names)))
    for i, j in pairs:
        s[i, j] = s[j, i] = row[f"c{i}_{j}"] * n

    # keep a feature only if earlier ones leave a part of it unexplained
    kept: list[int] = []
    for i in range(1, len(names)):
        left = s[i, i]
        if kept and left > 0:
            left -= s[i, kept] @ np.linalg.solve(s[np.ix_(kept, kept)], s[kept, i])
        if s[i, i] > 0 and left > 1e-9 * s[i, i]:
            kept.append(i)
    sxx = s[np.ix_(kept, kept)]
    slopes = np.linalg.solve(sxx, s[kept, 0]) if kept else np.array([])
    intercept = mean[0] - slopes @ mean[kept]
    rss = max(s[0, 0] - slopes @ s[kept, 0], 0.0)
    free = n - len(kept) - 1
    inv_slopes = np.linalg.inv(sxx) if kept else np.empty((0, 0))
    cross = -inv_slopes @ mean[kept]
    inverse = np.block([[np.array([[1 / n - mean[kept] @ cross]]), cross[None, :]], [cross[:, None], inv_slopes]])
    r2 = 1 - rss / s[0, 0] if s[0, 0] > 0 else float("nan")
    by_index = dict(zip(kept, (float(b) for b in slopes)))
    return LinearFit(
        target=target,
        features=tuple(features),
        coefficients=(float(intercept), *[by_index.get(i) for i in range(1, len(names))]),
        inverse=inverse,
        n=n,
        sigma=math.sqrt(rss / free) if free > 0 else float("nan"),
        r2=float(r2),
        adjusted_r2=float(1 - (1 - r2) * (n - 1) / free) if free > 0 else float("nan"),
    )


#: Tasks' factors are merged in so many groups before the last merge.
MERGE_GROUPS = 256
#: A column whose part that earlier columns do not explain is smaller, relative to its length, is left out.
DEPENDENT = 1e-10


def triangular_factor(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int] | None:
    """The factor R of the QR decomposition of (1, columns) over the complete rows, and their number.

    Every batch is reduced to a triangle of (columns + 1)^2 numbers; triangles are stacked and reduced
    again, inside a task, then in groups of tasks, then in one. Squares of values are never summed, so
    nearly dependent columns keep all their digits.
    """
    width = len(columns) + 1

    def reduce_rows(batches):
        r, n = np.zeros((0, width)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False) for c in batch.columns]])
            r, n = np.linalg.qr(np.vstack([r, x]), mode="r"), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    def merge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b).reshape(-1, width) for b in table.column("r").to_pylist()]
        r = np.linalg.qr(np.vstack(parts), mode="r")
        n = sum(table.column("n").to_pylist())
        return pa.Table.from_pydict({"r": pa.array([r.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    complete = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).dropna()
    parts = complete.mapInArrow(reduce_rows, "r binary, n long")
    grouped = parts.groupBy((F.spark_partition_id() % MERGE_GROUPS).alias("g")).applyInArrow(merge, "r binary, n long")
    row = grouped.groupBy(F.lit(0).alias("g")).applyInArrow(merge, "r binary, n long").first()
    if row is None:
        return None
    return np.frombuffer(row["r"]).reshape(-1, width), row["n"]


def fit_ols_by_factors(df: DataFrame, target: str, features: Sequence[str]) -> LinearFit:
    """Like ``fit_ols``, by merged triangular factors: for features that nearly depend on each other."""
    found = triangular_factor(df, [*features, target])
    if found is None or found[1] < 2:
        raise ValueError("a linear fit needs at least two complete rows")
    r, n = found
    lengths = np.linalg.norm(r, axis=0)
    kept = [0]
    for i in range(1, len(features) + 1):
        tried = np.linalg.qr(r[:, [*kept, i]], mode="r")
        if len(tried) > len(kept) and abs(tried[len(kept), len(kept)]) > DEPENDENT * lengths[i]:
            kept.append(i)
    r = np.linalg.qr(r[:, [*kept, len(features) + 1]], mode="r")
    r = np.vstack([r, np.zeros((max(len(kept) + 1 - len(r), 0), len(kept) + 1))])
    top, right = r[: len(kept), : len(kept)], r[: len(kept), -1]
    coefficients = np.linalg.solve(top, right)
    back = np.linalg.solve(top, np.eye(len(kept)))
    rss, spread = float(r[len(kept), -1] ** 2), float((r[1:, -1] ** 2).sum())
    free = n - len(kept)
    r2 = 1 - rss / spread if spread > 0 else float("nan")
    by_index = dict(zip(kept, map(float, coefficients)))
    return LinearFit(
        target=target,
        features=tuple(features),
        coefficients=(by_index[0], *[by_index.get(i) for i in range(1, len(features) + 1)]),
        inverse=back @ back.T,
        n=n,
        sigma=math.sqrt(rss / free) if free > 0 else float("nan"),
        r2=float(r2),
        adjusted_r2=float(1 - (1 - r2) * (n - 1) / free) if free > 0 else float("nan"),
    )


def residual_buckets(
    predicted: DataFrame, actual: str, pace: float, error_breaks: Sequence[float], target_breaks: Sequence[float]
) -> DataFrame:
    """Residual (actual - fit) scaled to a season pace, its rounded size, and bucket labels."""
    residual = (F.col(actual) - F.col("fit")) * pace
    return (
        predicted.withColumn("residual", residual)
        .withColumn("abs_residual", F.abs(half_even("residual")))
        .withColumn("error_bucket", bucket_label("abs_residual", error_breaks))
        .withColumn("target_bucket", bucket_label(actual, target_breaks))
    )


def residual_shape(df: DataFrame, residual: str, points: Sequence[float]) -> DataFrame:
    """Quantiles of the residuals beside their skewness and excess kurtosis, long form."""
    shape = df.agg(F.skewness(residual).alias("skewness"), F.kurtosis(residual).alias("kurtosis"))
    long = shape.unpivot([], ["skewness", "kurtosis"], "measure", "value")
    q = quantiles(df, [], residual, points).select(
        F.concat(F.lit("q"), F.format_number(F.col("point") * 100, 1)).alias("measure"), "value"
    )
    return q.unionByName(long)
