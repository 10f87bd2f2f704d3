"""Projection and row filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.hotgroups import with_group_stats


def _all_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point NaN means missing in every input table."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def within_bands(df: DataFrame, bands: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Keep rows whose columns all lie inside their closed bands; NULL fails."""
    return df.filter(_all_of(F.col(c).between(lo, hi) for c, (lo, hi) in bands.items()))


def one_of(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Membership in a short list, or in a one-column table when the list is long."""
    if isinstance(values, DataFrame):
        (name,) = values.columns
        keys = values.select(F.col(name).alias("_member"))
        return df.join(keys, F.col(column) == F.col("_member"), "left_semi")
    return df.filter(F.col(column).isin(list(values)))


#: Bits of a membership filter for each member, and bits it has at most (1 MiB).
FILTER_BITS, MOST_FILTER_BITS = 12, 1 << 23
_BITMAP = 32_768


def _bit(value: Column, salt: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(salt)), F.lit(bits)) + 1


def one_of_many(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """Membership in a large one-column table: a Bloom filter of the members drops rows where they are read,
    before the semi-join shuffles the others.

    The filter is built by an aggregate, has a bounded number of bits and is only a help: the semi-join
    decides. A member table too large for the filter makes it pass more rows, never fewer.
    """
    (name,) = members.columns
    keys = members.select(F.col(name).alias("_member")).where(F.col("_member").isNotNull())
    bits = max(_BITMAP, min(MOST_FILTER_BITS, FILTER_BITS * keys.count()))
    places = F.explode(F.array(*[_bit(F.col("_member"), salt, bits) for salt in (1, 2, 3)])).alias("h")
    maps = keys.select(places).groupBy(F.bitmap_bucket_number("h").alias("b"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bitmap"))
    table = maps.agg(F.map_from_entries(F.collect_list(F.struct("b", "bitmap"))).alias("m")).scalar()

    def marked(salt: int) -> Column:
        h = _bit(F.col(column), salt, bits)
        place = F.bitmap_bit_position(h)
        byte = F.substring(F.try_element_at(table, F.bitmap_bucket_number(h)), (F.floor(place / 8) + 1).cast("int"), F.lit(1))
        return F.call_function("shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")).bitwiseAND(1) == 1

    likely = df.filter(_all_of(marked(salt) for salt in (1, 2, 3)))
    return likely.join(keys, F.col(column) == F.col("_member"), "left_semi")


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=list(columns) if columns else None)


def drop_incomplete_entities(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Drop every entity with a missing value: 'drop columns with any NULL' on a long panel."""
    bad = df.filter(F.col(value).isNull()).select(F.col(entity).alias("_bad")).distinct()
    return df.join(bad, F.col(entity) == F.col("_bad"), "left_anti")


def complete_cross_sections(
    df: DataFrame, time: str, entity: str, value: str, config: Sequence[str] = ()
) -> DataFrame:
    """Keep the times at which every entity has a value: 'drop rows with any NULL' on a long panel.

    Rows with a NULL value are removed first, so an all-NULL time disappears as well. ``config``
    names further key columns that tell several panels in one table apart.
    """
    key = [*config, time]
    entities = df.agg(F.countDistinct(entity)).scalar()
    present = df.filter(F.col(value).isNotNull())
    full = (
        present.groupBy(*[F.col(c).alias(f"_at{i}") for i, c in enumerate(key)])
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == entities)
        .drop("_n")
    )
    return present.join(full, _all_of(F.col(c) == F.col(f"_at{i}") for i, c in enumerate(key)), "left_semi")


def between_days(
    df: DataFrame,
    time: str,
    first: dt.date | None = None,
    last: dt.date | None = None,
) -> DataFrame:
    """Rows from the start of ``first`` through the whole of ``last``; either end may be open."""
    conds = []
    if first is not None:
        conds.append(F.col(time) >= F.lit(first))
    if last is not None:
        conds.append(F.col(time) < F.lit(last + dt.timedelta(days=1)))
    return df.filter(_all_of(conds))


def override_when(df: DataFrame, column: str, cond: Column, value: Column | str) -> DataFrame:
    """Overwrite ``column`` on the rows where ``cond`` holds."""
    new = F.col(value) if isinstance(value, str) else value
    return df.withColumn(column, F.when(cond, new).otherwise(F.col(column)))


def rename_all(df: DataFrame, replace: Mapping[str, str] | None = None, suffix: str = "") -> DataFrame:
    """Replace substrings in every column name and append a suffix."""
    def new_name(name: str) -> str:
        for old, new in (replace or {}).items():
            name = name.replace(old, new)
        return name + suffix

    return df.toDF(*[new_name(c) for c in df.columns])


def keep_extreme(
    df: DataFrame, by: Sequence[str], value: str, keep_min: Column, keep_max: Column
) -> DataFrame:
    """Within each group keep the smallest-value rows where ``keep_min`` holds, the largest-value
    rows where ``keep_max`` holds, and every row where neither does."""
    out = with_group_stats(df, by, {"_low": F.min(value), "_high": F.max(value)})
    keep = (
        F.when(keep_min, F.col(value) == F.col("_low"))
        .when(keep_max, F.col(value) == F.col("_high"))
        .otherwise(True)
    )
    return out.filter(keep).drop("_low", "_high")


def skip_first(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Drop the first ``n`` rows of each group; ``order`` must be a total order.

    The n-th smallest order value of a group comes from a top-n that is cut down before the
    shuffle, so no task sees a whole group.
    """
    if n <= 0:
        return df
    heads = top_per_group(df.select(*dict.fromkeys([*by, *order])), by, order, n)
    last_skipped = heads.groupBy(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(by)]).agg(
        F.max(F.struct(*order)).alias("_skip_to")
    )
    match = _all_of(F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(by))
    return (
        df.join(last_skipped, match)
        .filter(F.struct(*order) > F.col("_skip_to"))
        .drop("_skip_to", *[f"_key{i}" for i in range(len(by))])
    )


def top_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows of each group; Spark limits each map task to ``k`` rows per group first."""
    from pyspark.sql import Window

    name = rank or "_rank"
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def slice_rows(df: DataFrame, allowed: Mapping[str, Sequence | None]) -> DataFrame:
    """Parameterised view: keep rows matching every given list; None or missing means no limit."""
    return df.filter(
        _all_of(F.col(c).isin(list(v)) for c, v in allowed.items() if v is not None)
    )


def masked(value: Column | str, cond: Column) -> Column:
    """``value`` where ``cond`` holds, else 0 (not NULL), NULL when the value is missing."""
    col = F.col(value) if isinstance(value, str) else value
    return F.when(col.isNotNull(), F.when(cond, col).otherwise(F.lit(0.0)))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
