"""Windows over groups that may be too large for one task.

A Spark window sends a whole group to one task. When one entity owns a large share of all rows that
task never ends, so once a group is above a row limit the table is partitioned by ranges of
(group, order) and every window is evaluated per (group, chunk):

* running totals and fills get the combined totals of the earlier ranges added;
* frames that reach a bounded number of rows back are cut by row number, and those rows are copied
  in front of each chunk.

Both give the same values as the uncut window, for order columns of any type that sorts. Nothing
that grows with the data is on the driver or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from statloom.session import cut_lineage

LIMIT_CONF = "statloom.maxGroupRows"
DEFAULT_LIMIT = 2_000_000
AUTO = "auto"
#: Cells of groups that are counted before single groups are.
CELLS = 4096


def row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_CONF, str(DEFAULT_LIMIT)))


def _match(names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for i, name in enumerate(names):
        cond = cond & F.col(name).eqNullSafe(F.col(f"_key{i}"))
    return cond


@dataclass(frozen=True)
class HotGroups:
    """States that a group is above the limit."""

    limit: int


def find_hot(
    df: DataFrame, by: Sequence[str], order: str, limit: int | None = None
) -> HotGroups | None:
    """Whether a group of ``df`` is above the row limit: ``HotGroups``, or None.

    Rows are counted in ``CELLS`` cells of groups first, so little is shuffled; only the groups of cells above the
    limit are counted one by one.
    """
    limit = limit or row_limit(df)
    rows = df.select(*by, F.pmod(F.xxhash64(*by), F.lit(CELLS)).alias("_cell"))
    cells = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    large = [r["_cell"] for r in cells.collect()]  # CELLS rows at most
    if not large:
        return None
    groups = rows.filter(F.col("_cell").isin(large)).groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    return HotGroups(limit) if groups.filter(F.col("_rows") > limit).limit(1).count() else None


def find_hot_early(df: DataFrame, by: Sequence[str]) -> None | str:
    """None if no group of ``df`` is above the limit, else ``AUTO``.

    For a step on a table made from ``df`` that has no larger groups: when ``df`` is cheap to read, the table
    need not be made once more just to be counted.
    """
    return None if find_hot(df, by, by[0]) is None else AUTO


def with_lookback(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    lookback: int,
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    hot: HotGroups | None | str = AUTO,
) -> DataFrame:
    """Apply ``add(df, window)`` whose frames reach at most ``lookback`` rows back.

    With a large group, rows are numbered in order, every chunk gets equally many of them, and the
    last ``lookback`` rows before a chunk join it too.
    """
    if hot == AUTO:
        hot = find_hot(df, by, order[0])
    if hot is None:
        return add(df, Window.partitionBy(*by).orderBy(*order))
    size = max(hot.limit, lookback)
    numbered = running(df, by, order, sums={"_row": F.lit(1).cast("bigint")}, hot=hot)
    own, last = (F.floor((F.col("_row") - 1 + n) / size) for n in (0, lookback))
    cut = numbered.withColumn("_chunk", F.explode(F.sequence(own, last))).withColumn("_home", F.col("_chunk") == own)
    window = Window.partitionBy(*by, "_chunk").orderBy(*order, "_row")
    return add(cut, window).filter("_home").drop("_chunk", "_home", "_row")


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column | str] | None = None,
    fills: dict[str, Column | str] | None = None,
    include_current: bool = True,
    hot: HotGroups | None | str = AUTO,
) -> DataFrame:
    """Running sums and last-seen values from the start of each group to the current row.

    ``sums`` maps a new column to the summed expression (``F.lit(1)`` numbers the rows); ``fills``
    maps a new column to the expression whose last non-NULL value is carried. With
    ``include_current=False`` the current row is left out. ``by`` may be empty.
    """
    sums, fills = sums or {}, fills or {}
    if not by:
        out = running(
            df.withColumn("_all", F.lit(0)), ["_all"], order, sums, fills, include_current, hot
        )
        return out.drop("_all")
    if hot == AUTO:
        hot = find_hot(df, by, order[0])
    stop = 0 if include_current else -1

    def frames(window: WindowSpec) -> dict[str, Column]:
        w = window.rowsBetween(Window.unboundedPreceding, stop)
        cols = {name: F.sum(x).over(w) for name, x in sums.items()}
        cols |= {
            name: F.last(F.col(x) if isinstance(x, str) else x, ignorenulls=True).over(w)
            for name, x in fills.items()
        }
        return cols

    if hot is None:
        return df.withColumns(frames(Window.partitionBy(*by).orderBy(*order)))

    # written, so that a range keeps its number whatever is computed again later
    ranges = df.repartitionByRange(*[F.col(c).asc() for c in (*by, *order)])
    parts = cut_lineage(ranges.withColumn("_chunk", F.spark_partition_id()))
    at = F.struct(*order)
    totals = parts.groupBy(*by, "_chunk").agg(
        *[F.sum(x).alias(name) for name, x in sums.items()],
        *[
            F.max_by(x, F.when((F.col(x) if isinstance(x, str) else x).isNotNull(), at)).alias(name)
            for name, x in fills.items()
        ],
    )
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(by)],
        F.col("_chunk").alias("_key_chunk"),
        *[F.sum(name).over(before).alias(f"_carry_{name}") for name in sums],
        *[F.last(name, ignorenulls=True).over(before).alias(f"_carry_{name}") for name in fills],
    )
    local = parts.withColumns(frames(Window.partitionBy(*by, "_chunk").orderBy(*order)))
    out = local.join(carry, _match(by) & (F.col("_chunk") == F.col("_key_chunk")), "left")
    fixed = {
        name: F.when(
            F.col(name).isNotNull() | F.col(f"_carry_{name}").isNotNull(),
            F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_carry_{name}"), F.lit(0)),
        )
        for name in sums
    } | {name: F.coalesce(F.col(name), F.col(f"_carry_{name}")) for name in fills}
    return out.withColumns(fixed).drop(
        "_chunk",
        "_key_chunk",
        *[f"_key{i}" for i in range(len(by))],
        *[f"_carry_{n}" for n in (*sums, *fills)],
    )


def with_group_stats(df: DataFrame, by: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Attach per-group aggregates to every row.

    Aggregate-then-join instead of an unordered window: rows are combined before the shuffle, and
    the join back is broadcast by size or split by the skew-join rule.
    """
    by = list(by)
    totals = df.groupBy(*by).agg(*[x.alias(name) for name, x in stats.items()])
    totals = totals.select(
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(by)], *stats.keys()
    )
    return df.join(totals, _match(by), "left").drop(*[f"_key{i}" for i in range(len(by))])
