"""Pearson correlation of wide tables by blocked Gram matrices.

A pair of columns needs five sums over the rows where both are present. Written as aggregate expressions
that is a number of expressions that grows with the square of the columns, more than a plan of hundreds of
columns bears. Here a batch of rows becomes a matrix with zeros for missing values and a mask; products of
the two give all sums of a block of columns with another at once. Each task adds up its batches and sends
one row for each pair of columns, and Spark adds up the tasks.

Columns are first centred on their mean over all rows, so the sums do not cancel when means are large.
A task holds five matrices of (columns x columns) numbers and one batch.

Missing values drop pairwise; NaN counts as a value, and makes its correlations NaN. A pair with fewer than
two common rows, or a column without spread there, has no correlation. No rows give no correlations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block: one product handles a block with a block.
BLOCK = 64
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_sums(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """i, j (column numbers, i <= j) and the sums over rows where both are present, of centred values."""
    p = len(columns)
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    # an approximate centre is enough, but it must not be NaN or infinite
    centre = values.agg(*[F.avg(F.when(F.abs(F.col(f"c{i}")) < 1e300, F.col(f"c{i}"))).alias(f"c{i}") for i in range(p)]).first()
    shift = np.array([x if x is not None else 0.0 for x in centre])
    left, right = np.triu_indices(p)
    spans = [(a, min(a + block, p)) for a in range(0, p, block)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = (np.zeros((p, p)) for _ in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            mask = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.where(mask, x - shift, 0.0)
            m = mask.astype(float)
            for a, b in spans:
                squares = x[:, a:b] ** 2
                for c, d in spans:
                    n[a:b, c:d] += m[:, a:b].T @ m[:, c:d]
                    sx[a:b, c:d] += x[:, a:b].T @ m[:, c:d]
                    sxx[a:b, c:d] += squares.T @ m[:, c:d]
                    if c >= a:
                        sxy[a:b, c:d] += x[:, a:b].T @ x[:, c:d]
        sums = (n[left, right], sx[left, right], sx[right, left], sxx[left, right], sxx[right, left], sxy[left, right])
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int32()), pa.array(right, pa.int32()), *map(pa.array, sums)], ["i", "j", *SUMS]
        )

    schema = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
    return values.mapInArrow(add, schema).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def wide_correlations(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """var1, var2, r for every ordered pair of columns, like ``aggregate.correlation_matrix``."""
    sums = pair_sums(df, columns, block)
    n = F.col("n")
    spread = lambda s, q: F.col(q) - F.col(s) * F.col(s) / n
    across = F.col("sxy") - F.col("sx") * F.col("sy") / n
    flat = (spread("sx", "sxx") <= 0) | (spread("sy", "syy") <= 0)
    r = F.when((n > 1) & ~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), across / F.sqrt(spread("sx", "sxx") * spread("sy", "syy")))))
    r = F.when((n > 1) & F.isnan(across), F.lit(float("nan"))).otherwise(r)
    names = F.array(*map(F.lit, columns))
    named = sums.where(n > 0).select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), r.alias("r"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    out = named.withColumn("_pair", F.explode(both)).select(F.col("_pair.a").alias("var1"), F.col("_pair.b").alias("var2"), "r")
    # a pair without common rows is reported without a correlation
    spark = df.sparkSession
    all_ = spark.range(len(columns)).select(F.explode(names).alias("var2"), F.get(names, F.col("id").cast("int")).alias("var1"))
    return all_.join(out, ["var1", "var2"], "left").select("var1", "var2", "r")
