"""Numbering rows and adding them up in order, without one task for a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.session import cut_lineage


def in_parts(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partition by (``by``, ``order``) and write the rows with their part in ``_part``.

    A large group spreads over many parts; the parts follow the order, nulls first unless ``order``
    says otherwise. Written, so that a part's number holds whatever is computed again later.
    """
    parts = df.repartitionByRange(*[F.col(c).asc() for c in by], *order)
    return cut_lineage(parts.withColumn("_part", F.spark_partition_id()))


def running(parts: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums, the current row included, over rows made by ``in_parts`` with the same keys.

    Each part adds up by itself; the totals of earlier parts, at most one row per group and part, are
    joined on. The order must be total, up to rows that are equal in all that is added.
    """
    by = list(by)
    totals = parts.groupBy(*by, "_part").agg(*[F.sum(x).alias(f"_sum_{n}") for n, x in sums.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)],
        F.col("_part").alias("_of_part"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({n: F.sum(x).over(within) for n, x in sums.items()})
    same = F.col("_part") == F.col("_of_part")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    out = local.join(carry, same, "left")
    out = out.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums})
    return out.drop("_part", "_of_part", *[f"_by_{i}" for i in range(len(by))], *[f"_before_{n}" for n in sums])
