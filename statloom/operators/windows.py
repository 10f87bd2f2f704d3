"""Per-entity ordered features: numbering, running totals, lags, fills, expanding and prior means."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.hotgroups import AUTO, HotGroups, running, with_group_stats, with_lookback

Hot = HotGroups | None | str


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, hot: Hot = AUTO) -> DataFrame:
    return running(df, by, order, sums={name: F.lit(1).cast("bigint")}, hot=hot)


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Mapping[str, str | Column], hot: Hot = AUTO
) -> DataFrame:
    """Cumulative sums, ``{new column: summed expression}``."""
    return running(df, by, order, sums=dict(columns), hot=hot)


def prior_average(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str],
    weight: str | None = None,
    inclusive_weight: bool = False,
    hot: Hot = AUTO,
) -> DataFrame:
    """Average of the rows before the current one, 0 where there is none.

    With ``weight`` the prior total is divided by the prior weight total instead of the prior row
    count (points per game); ``inclusive_weight`` counts the current row's weight too.
    """
    prior = {f"_p_{new}": F.col(old) for new, old in columns.items()}
    size = F.col(weight) if weight else F.lit(1)
    out = running(df, by, order, sums={**prior, "_w": size}, include_current=False, hot=hot)
    below = F.col("_w")
    if inclusive_weight:
        below = F.coalesce(below, F.lit(0)) + size
    rates = {new: F.coalesce(F.try_divide(F.col(f"_p_{new}"), below), F.lit(0.0)) for new in columns}
    return out.withColumns(rates).drop("_w", *prior)


def trailing_average(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], k: int, suffix: str | None = None, hot: Hot = AUTO
) -> DataFrame:
    """Average of the current and the ``k - 1`` previous rows; NULL until all ``k`` are there."""
    tail = suffix if suffix is not None else f"_avg_L{k}"

    def add(d, window):
        w = window.rowsBetween(-(k - 1), 0)
        return d.withColumns(
            {c + tail: F.when(F.count(c).over(w) == k, F.avg(c).over(w)) for c in columns}
        )

    return with_lookback(df, by, order, k - 1, add, hot)


def prior_trailing_average(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Mapping[str, str], k: int, hot: Hot = AUTO
) -> DataFrame:
    """Average of up to ``k`` rows before the current one, the current row excluded."""
    def add(d, window):
        w = window.rowsBetween(-k, -1)
        return d.withColumns({new: F.avg(old).over(w) for new, old in columns.items()})

    return with_lookback(df, by, order, k, add, hot)


def shifted(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], steps: Sequence[int] = (1,), suffix: str = "_prev", hot: Hot = AUTO
) -> DataFrame:
    """Add ``{column}{suffix}{n}``: the value ``n`` rows earlier."""
    def add(d, window):
        return d.withColumns(
            {f"{c}{suffix}{n}": F.lag(c, n).over(window) for c in columns for n in steps}
        )

    return with_lookback(df, by, order, max(steps), add, hot)


def expanding(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    means: Mapping[str, str | Column] | None = None,
    totals: Mapping[str, str | Column] | None = None,
    ratios: Mapping[str, tuple[str | Column, str | Column]] | None = None,
    include_current: bool = True,
    hot: Hot = AUTO,
) -> DataFrame:
    """Means, sums and ratios of sums from the start of the group to the current row.

    An expression that is NULL on some rows (``F.when(cond, x)``) is averaged over the others.
    """
    col = lambda x: F.col(x) if isinstance(x, str) else x
    sums: dict[str, Column] = {}
    done: dict[str, Column] = {}
    for name, x in (means or {}).items():
        sums[f"_s_{name}"] = col(x)
        sums[f"_n_{name}"] = F.when(col(x).isNotNull(), 1)
        done[name] = F.try_divide(F.col(f"_s_{name}"), F.col(f"_n_{name}"))
    for name, x in (totals or {}).items():
        sums[f"_s_{name}"] = col(x)
        done[name] = F.col(f"_s_{name}")
    for name, (top, bottom) in (ratios or {}).items():
        sums[f"_s_{name}"], sums[f"_n_{name}"] = col(top), col(bottom)
        done[name] = F.try_divide(F.col(f"_s_{name}"), F.col(f"_n_{name}"))
    out = running(df, by, order, sums=sums, include_current=include_current, hot=hot)
    return out.withColumns(done).drop(*sums)


def forward_fill(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], hot: Hot = AUTO
) -> DataFrame:
    """Replace NULLs by the last earlier value. Empty ``by`` fills across all rows in order."""
    names = {f"_fill_{c}": c for c in columns}
    out = running(df, by, order, fills=names, hot=hot)
    return out.withColumns({c: F.col(f) for f, c in names.items()}).drop(*names)


def quantile_bucket(
    df: DataFrame, by: Sequence[str], value: str, tiebreak: Sequence[str], buckets: int, name: str, hot: Hot = AUTO
) -> DataFrame:
    """``ntile`` by ascending value inside each group; rows without a value get NULL."""
    part = [*by, "_has"]
    rows = df.withColumn("_has", F.col(value).isNotNull())
    rows = with_group_stats(rows, part, {"_size": F.count(F.lit(1))})
    rows = number_rows(rows, part, [value, *tiebreak], "_rn", hot)
    small = F.floor(F.col("_size") / buckets)
    extra = F.col("_size") % buckets
    in_large = extra * (small + 1)
    tile = F.when(
        F.col("_rn") <= in_large, F.floor((F.col("_rn") - 1) / (small + 1)) + 1
    ).otherwise(extra + F.floor(F.try_divide(F.col("_rn") - 1 - in_large, small)) + 1)
    return rows.withColumn(name, F.when(F.col("_has"), tile.cast("int"))).drop("_has", "_rn", "_size")


def simple_return(
    df: DataFrame, by: Sequence[str], order: Sequence[str], price: str, name: str = "ret", hot: Hot = AUTO
) -> DataFrame:
    def add(d, window):
        return d.withColumn(name, F.try_divide(F.col(price), F.lag(price).over(window)) - 1)

    return with_lookback(df, by, order, 1, add, hot)


def curve(df: DataFrame, order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Running totals of a whole series (one row per time)."""
    return running(df, [], order, sums=dict(columns))


