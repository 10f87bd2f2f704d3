"""Exact order statistics by refining value cells.

The values of a group are never sorted or shuffled as a whole. A first pass counts them in logarithmic
cells; the cell that holds a wanted rank is known from the counts of the cells before it. Only that cell
is cut again, into equal parts between its smallest and largest value, and again, until it holds few rows
(or only one value), which are then sorted. Cells are made by functions that never decrease, so a
cell is an interval of values: its rows are found again by comparing with its smallest and largest value.

A pass shuffles one row for each task and non-empty cell. Within a logarithmic cell values differ by
less than 3 percent; each later pass makes a cell 4,096 times narrower, so five passes end at single
doubles whatever the values are. What is left then, integers or decimals that share a double, is counted by
value. A group, however large, and a value, however frequent, costs no task more than the rows it reads.

Ranks start at 0. Missing values have no rank; NaN comes after all other values, as Spark sorts it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.operators.hotgroups import _match
from statloom.session import cut_lineage

#: Logarithmic cells for each factor of e.
PER_E = 40
#: Parts a cell is cut into by a later pass.
PARTS = 4096
#: Rows of a cell that are sorted in one task.
FEW_CONF = "statloom.sortedCellRows"
FEW = 65_536
#: Passes after the first; the last finds single doubles.
PASSES = 6


def _few(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(FEW_CONF, str(FEW)))


def log_cell(x: Column) -> Column:
    """Number of the logarithmic cell of a double; never decreases with it."""
    place = F.floor((F.ln(F.abs(x)) + 746) * PER_E) + 1
    most = 1500 * PER_E
    return (
        F.when(F.isnan(x), most + 1)
        .when(x == float("inf"), most)
        .when(x == float("-inf"), -most)
        .when(x == 0, 0)
        .when(x > 0, place)
        .otherwise(-place)
        .cast("int")
    )


def linear_cell(x: Column, low: Column, high: Column) -> Column:
    """Which of ``PARTS`` equal parts of [low, high] holds a value. The halves keep the width finite."""
    share = F.try_divide(x / 2 - low / 2, high / 2 - low / 2)
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * PARTS), F.lit(PARTS - 1)).cast("int")


def _attach(rows: DataFrame, by: Sequence[str], table: DataFrame, column: str) -> DataFrame:
    """Add ``column`` of a table that has one row per group (a single row without ``by``)."""
    if not by:
        return rows.withColumn(column, table.select(column).scalar())
    keyed = table.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(by)], column)
    return rows.join(keyed, _match(by)).drop(*[f"_key{i}" for i in range(len(by))])


def _placed(cells: DataFrame, parts_of: Sequence[str], wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """For each wanted rank the cell that holds it: the rank inside the cell, its rows, ends.

    ``cells`` has ``parts_of``, _cell, _n, _min, _max; ``wanted`` has ``parts_of`` and an array
    ``_ranks`` of the ranks looked for in each of these parts.
    """
    before = Window.partitionBy(*parts_of).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = F.filter("_ranks", lambda r: (r["at"] >= F.col("_before")) & (r["at"] < F.col("_before") + F.col("_n")))
    met = _attach(counted, parts_of, wanted, "_ranks").withColumn("_own", own).where(F.size("_own") > 0)
    moved = F.transform("_own", lambda r: F.struct(r["rank"].alias("rank"), (r["at"] - F.col("_before")).alias("at")))
    return met.select(*key, moved.alias("_ranks"), "_n", "_min", "_max")


def ranked_values(df: DataFrame, by: Sequence[str], value: str, ranks: Column) -> DataFrame:
    """by, rank, value, total: the values at the ranks that ``ranks``, an array of bigints made from
    ``_total`` (the number of values of a group), asks for. Ranks outside a group are left out."""
    by = list(by)
    few = _few(df)
    cells = [F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.count(F.lit(1)).alias("_n")]
    rows = cut_lineage(df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_x")))
    x = F.col("_x").cast("double")

    first = cut_lineage(rows.groupBy(*by, log_cell(x).alias("_cell")).agg(*cells))
    totals = first.groupBy(*by).agg(F.sum("_n").alias("_total")).where(F.col("_total") > 0)
    asked = F.filter(F.array_distinct(ranks), lambda r: (r >= 0) & (r < F.col("_total")))
    wanted = totals.select(*by, "_total", F.transform(asked, lambda r: F.struct(r.alias("rank"), r.alias("at"))).alias("_ranks"))
    holding = cut_lineage(_placed(first, by, wanted, by))

    done: list[DataFrame] = []
    known = lambda r: (r["at"] == 0) | (r["at"] == F.col("_n") - 1) | (F.col("_min") == F.col("_max"))
    for turn in range(PASSES + 1):
        # a cell's smallest and largest value are known already
        held = F.transform(F.filter("_ranks", known), lambda r: F.struct(r["rank"].alias("rank"), F.when(r["at"] == 0, F.col("_min")).otherwise(F.col("_max")).alias("value")))
        done.append(holding.select(*by, F.inline(held)))
        open_ = holding.withColumn("_ranks", F.filter("_ranks", lambda r: ~known(r))).where(F.size("_ranks") > 0)
        largest = open_.agg(F.max("_n")).first()[0]
        if largest is None:
            break
        per_group = open_.groupBy(*by).agg(F.collect_list(F.struct("_min", "_max", "_n", "_ranks")).alias("_open"))
        inside = F.filter("_open", lambda c: F.col("_x").between(c["_min"], c["_max"]))
        # the intervals of a group do not overlap, so a row lies in one of them at most
        found = _attach(rows, by, per_group, "_open").withColumn("_in", F.get(inside, F.lit(0))).where(F.col("_in").isNotNull())
        found = found.select(*by, "_x", "_in.*")
        cell = [*by, "_min"]
        if largest <= few:
            place = F.row_number().over(Window.partitionBy(*cell).orderBy("_x")).cast("bigint") - 1
            hit = found.withColumn("_place", place).select(*by, "_x", "_place", F.explode("_ranks").alias("_r"))
            done.append(hit.where(F.col("_place") == F.col("_r.at")).select(*by, "_r.rank", F.col("_x").alias("value")))
            break
        if turn == PASSES:
            same = found.groupBy(*cell, "_x", "_ranks").agg(F.count(F.lit(1)).alias("_n"))
            upto = F.sum("_n").over(Window.partitionBy(*cell).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
            hit = same.withColumn("_upto", upto).select(*by, "_x", "_n", "_upto", F.explode("_ranks").alias("_r"))
            holds = (F.col("_r.at") < F.col("_upto")) & (F.col("_r.at") >= F.col("_upto") - F.col("_n"))
            done.append(hit.where(holds).select(*by, "_r.rank", F.col("_x").alias("value")))
            break
        low, high = F.col("_min").cast("double"), F.col("_max").cast("double")
        parted = found.select(*by, "_x", F.col("_min").alias("_from"), linear_cell(x, low, high).alias("_cell"))
        counted = parted.groupBy(*by, "_from", "_cell").agg(*cells)
        looked = open_.select(*by, F.col("_min").alias("_from"), "_ranks")
        holding = cut_lineage(_placed(counted, [*by, "_from"], looked, by))
    out = reduce(DataFrame.unionByName, done)
    return _attach(out, by, totals, "_total").withColumnRenamed("_total", "total")


def quantiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbouring ranks, one row per (group, point)."""
    by = list(by)
    at = [((F.col("_total") - 1) * F.lit(float(p))) for p in points]
    ranks = F.array(*[f(a).cast("bigint") for a in at for f in (F.floor, F.ceil)])
    found = ranked_values(df, by, value, ranks)
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("point")
    pos = (F.col("total") - 1) * F.col("point")
    low, high = F.floor(pos), F.ceil(pos)
    hits = found.select("*", wanted).where((F.col("rank") == low) | (F.col("rank") == high))
    ends = hits.groupBy(*by, "point").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.max(pos - low).alias("_f")
    )
    return ends.select(*by, "point", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value"))
