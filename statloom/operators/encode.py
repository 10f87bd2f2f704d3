"""Label codes, indicator columns and exact stratified splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.scalar import MIX_MODULUS, with_lanes
from statloom.operators.windows import number_rows
from statloom.session import cut_lineage

HASH_CELLS = 1024


def code_table(df: DataFrame, column: str) -> DataFrame:
    """``value``, ``code``: the sorted distinct values of a column numbered from 0, NULL left out.

    The table is written, so that Spark knows its size: rows that meet few codes are not shuffled by them.
    """
    values = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return cut_lineage(number_rows(values, [], ["value"], "_place").select("value", (F.col("_place") - 1).cast("int").alias("code")))


def with_code(df: DataFrame, column: str, codes: DataFrame, name: str = "code") -> DataFrame:
    """Add the code of every value; NULL for values that the table does not have."""
    table = codes.select(F.col("value").alias("_value"), F.col("code").alias(name))
    return df.join(table, F.col(column) == F.col("_value"), "left").drop("_value")


def with_value(df: DataFrame, code: str, codes: DataFrame, name: str) -> DataFrame:
    """The value that a code stands for."""
    table = codes.select(F.col("code").alias("_code"), F.col("value").alias(name))
    return df.join(table, F.col(code) == F.col("_code"), "left").drop("_code")


#: Levels that become output columns at most.
MOST_LEVELS = 1000


def levels_of(df: DataFrame, column: str, most: int = MOST_LEVELS) -> list:
    """Sorted distinct values of a column that becomes one output column per value.

    More than ``most`` are an error, found without collecting them; ``indicator_rows`` has no limit.
    """
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} levels: use indicator_rows")
    return sorted(r[0] for r in found)


def indicator_rows(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The ones of ``one_hot`` in long form, ``column`` and ``level``, for any number of levels.

    As there, the smallest level of a column and NULL have no row.
    """
    long = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(list(ids), list(columns), "column", "level")
    first = df.select(*[F.min(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "_column", "_first")
    rows = long.where(F.col("level").isNotNull())
    return rows.join(first, (F.col("column") == F.col("_column")) & (F.col("level") != F.col("_first"))).drop("_column", "_first")


def one_hot(df: DataFrame, columns: Mapping[str, Sequence | None]) -> DataFrame:
    """0/1 columns ``{column}_{level}`` for every level but the first; NULL gives all zeros."""
    made = {}
    for column, levels in columns.items():
        for level in list(levels if levels is not None else levels_of(df, column))[1:]:
            made[f"{column}_{level}"] = F.when(F.col(column) == level, 1).otherwise(0)
    return df.withColumns(made)


def stratified_split(
    df: DataFrame, label: str, key: str, fraction: float = 0.2, seed: int = 13, name: str = "is_test"
) -> DataFrame:
    """Flag exactly ``round(fraction * n)`` rows of every label, in scrambled key order.

    Counts per hash cell find the cell in which a label's quota runs out, and only that cell's rows
    are ordered, so the table itself is neither sorted nor shuffled by label. ``key`` is unique, an
    integer or text.
    """
    keyed = with_lanes(df, "_lane_a", "_lane_b", seed, key)
    rows = keyed.withColumn("_place", F.col("_lane_a") * MIX_MODULUS + F.col("_lane_b")).drop("_lane_a", "_lane_b")
    # never NULL: a test for NULL would be pushed below the scrambling steps, each of which reads the one
    # before it more than once, and be written out in full
    cell = F.floor(F.col("_place") / (MIX_MODULUS * MIX_MODULUS // HASH_CELLS)).cast("int")
    rows = rows.withColumn("_cell", F.coalesce(cell, F.lit(-1)))
    cells = rows.groupBy(label, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    quota = cells.groupBy(label).agg(F.bround(F.sum("_n") * fraction).cast("bigint").alias("_quota"))
    # a label has at most HASH_CELLS + 1 cells
    filled = cells.withColumn("_upto", F.sum("_n").over(Window.partitionBy(label).orderBy("_cell")))
    # written, as are the cuts: few rows, so that Spark need not shuffle the others by label
    last_cell = cut_lineage(
        filled.join(quota, label)
        .filter((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota")))
        .select(
            F.col(label).alias("_label"),
            F.col("_cell").alias("_last"),
            (F.col("_quota") - (F.col("_upto") - F.col("_n"))).alias("_left"),
        )
    )
    same_label = F.col(label) == F.col("_label")
    edge = rows.join(last_cell, same_label & (F.col("_cell") == F.col("_last")))
    edge = number_rows(edge, [label], ["_place", key], "_rn").filter(F.col("_rn") == F.col("_left"))
    cut = cut_lineage(edge.select("_label", F.struct("_place", key).alias("_cut")))
    return (
        rows.join(cut, same_label, "left")
        .withColumn(name, F.coalesce(F.struct("_place", key) <= F.col("_cut"), F.lit(False)))
        .drop("_place", "_cell", "_label", "_cut")
    )


def with_folds(df: DataFrame, key: str, folds: int, seed: int = 13, name: str = "fold") -> DataFrame:
    """Fold number from a scrambled key, for cross-validation."""
    keyed = with_lanes(df, "_lane_a", "_lane_b", seed, key)
    return keyed.withColumn(name, (F.col("_lane_a") % folds).cast("int")).drop("_lane_a", "_lane_b")
