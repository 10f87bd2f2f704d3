"""Keyed joins: lookups, opponent rows, outer alignment, suffixed merges, parameter choices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str] | Sequence[str],
    columns: Sequence[str] | None = None,
    how: str = "left",
) -> DataFrame:
    """Equi-join on ``{left name: right name}`` keeping the left keys and the chosen right columns."""
    pairs = dict(on) if isinstance(on, Mapping) else {k: k for k in on}
    keep = list(columns) if columns is not None else [
        c for c in right.columns if c not in pairs.values()
    ]
    keyed = right.select(
        *[F.col(r).alias(f"_on{i}") for i, r in enumerate(pairs.values())], *keep
    )
    cond = reduce(
        lambda a, b: a & b, [F.col(l) == F.col(f"_on{i}") for i, l in enumerate(pairs)]
    )
    return left.join(keyed, cond, how).drop(*[f"_on{i}" for i in range(len(pairs))])


def first_match(left: DataFrame, dim: DataFrame, on: Mapping[str, str], order: str, columns: Sequence[str]) -> DataFrame:
    """Lookup that takes the first dimension row per key, in ``order``."""
    keys = list(on.values())
    firsts = dim.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in columns])
    return lookup(left, firsts, on, columns)


def opponent_lookup(
    left: DataFrame,
    right: DataFrame,
    game: str,
    team: str,
    opponent: str,
    columns: Sequence[str],
    suffix: str = "",
) -> DataFrame:
    """Attach the rows that name this row's team as their opponent in the same game."""
    other = right.select(game, opponent, *[F.col(c).alias(c + suffix) for c in columns])
    return lookup(left, other, {game: game, team: opponent}, [c + suffix for c in columns])


def join_suffixed(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    suffixes: tuple[str, str] = ("", "_old"),
) -> DataFrame:
    """Join where columns present on both sides get the given suffixes."""
    shared = (set(left.columns) & set(right.columns)) - set(on)
    left_named = left.select(*[F.col(c).alias(c + suffixes[0]) if c in shared else c for c in left.columns])
    right_named = right.select(*[F.col(c).alias(c + suffixes[1]) if c in shared else c for c in right.columns])
    return left_named.join(right_named, list(on), how)


def align_outer(
    left: DataFrame, right: DataFrame, on: Sequence[str], fill: Mapping[str, float]
) -> DataFrame:
    """Full outer alignment on an index with fill values for the side that is missing."""
    out = left.join(right, list(on), "full_outer")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def with_choices(df: DataFrame, choices: Sequence[Mapping[str, float | int | str]]) -> DataFrame:
    """Repeat every row once per parameter setting.

    The settings are a short caller-given list, so this is a row generator inside the scan stage,
    not a join.
    """
    settings = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in choices])
    return df.select("*", F.inline(settings))


def union_named(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ordered_lookup(
    matches: DataFrame, info: DataFrame, match: str, info_key: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Info rows for each (subject, position, match) row. Matches are kept long, so the position is
    a column and a subject's own row is position 0."""
    return lookup(matches, info, {match: info_key or match}, columns)


def explode_lists(
    df: DataFrame, key: Sequence[str], first: str, second: str, suffix: str, position: str = "list_position"
) -> DataFrame:
    """Flatten two struct lists of a record side by side: element i of one next to element i of the
    other, the second list's fields suffixed. A record with both lists empty keeps one row."""
    def fields(column: str) -> list[str]:
        return df.schema[column].dataType.elementType.names

    pairs = F.arrays_zip(
        F.coalesce(F.col(first), F.array()).alias("a"), F.coalesce(F.col(second), F.array()).alias("b")
    )
    rows = df.select(*key, F.posexplode_outer(pairs).alias("_pos", "_pair"))
    return rows.select(
        *key,
        F.coalesce(F.col("_pos"), F.lit(0)).alias(position),
        *[F.col(f"_pair.a.{f}").alias(f) for f in fields(first)],
        *[F.col(f"_pair.b.{f}").alias(f + suffix) for f in fields(second)],
    )


def equal_all(pairs: Mapping[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(l) == F.col(r) for l, r in pairs.items()])
