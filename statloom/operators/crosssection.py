"""Across-entity statistics at each time: average rank, demeaned unit-gross weights, turnover.

``at`` is the list of columns naming a cross-section: the time, or the time and a configuration.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.operators.hotgroups import AUTO, HotGroups, find_hot, running, with_group_stats, with_lookback

Hot = HotGroups | None | str


def average_rank(df: DataFrame, at: Sequence[str], value: str, name: str = "rank", hot: Hot = AUTO) -> DataFrame:
    """Ascending rank inside each cross-section, ties averaged, missing values unranked.

    ``hot=None`` states that a cross-section fits a task (entities per time are known to be few).
    """
    at = list(at)
    if hot == AUTO:
        hot = find_hot(df, at, value)
    if hot is None:
        rank = F.rank().over(Window.partitionBy(*at).orderBy(F.col(value).asc_nulls_last()))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*at, value))
        return df.withColumn(name, F.when(F.col(value).isNotNull(), rank + (ties - 1) / 2))
    # a very large cross-section: rank its distinct values, then look the ranks up
    counts = df.filter(F.col(value).isNotNull()).groupBy(*at, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running(counts, at, [value], sums={"_upto": "_n"}).select(
        *[F.col(c).alias(f"_at{i}") for i, c in enumerate(at)],
        F.col(value).alias("_value"),
        (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name),
    )
    cond = F.col(value) == F.col("_value")
    for i, c in enumerate(at):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_at{i}"))
    return df.join(ranks, cond, "left").drop("_value", *[f"_at{i}" for i in range(len(at))])


def demean_and_scale(df: DataFrame, at: Sequence[str], value: str, name: str = "weight", hot: Hot = AUTO) -> DataFrame:
    """Subtract the cross-section mean, divide by the sum of absolute values.

    Cross-sections whose values are all equal have no gross exposure and are removed.
    """
    at = list(at)
    if hot == AUTO:
        hot = find_hot(df, at, value)
    if hot is None:
        w = Window.partitionBy(*at)
        out = df.withColumn("_centred", F.col(value) - F.avg(value).over(w))
        out = out.withColumn("_gross", F.sum(F.abs("_centred")).over(w))
    else:
        out = with_group_stats(df, at, {"_mean": F.avg(value)})
        out = out.withColumn("_centred", F.col(value) - F.col("_mean")).drop("_mean")
        out = with_group_stats(out, at, {"_gross": F.sum(F.abs("_centred"))})
    out = out.withColumn(name, F.try_divide(F.col("_centred"), F.col("_gross")))
    return out.filter(F.col(name).isNotNull()).drop("_centred", "_gross")


def lag_weights(
    weights: DataFrame,
    time: str,
    entity: str,
    weight: str,
    name: str = "held",
    periods: int = 1,
    step: str | None = None,
    config: Sequence[str] = (),
    hot: Hot = AUTO,
) -> DataFrame:
    """Weight decided ``periods`` rows earlier for the same entity.

    By default the previous surviving row counts, however long ago; with ``step`` (an interval such
    as ``'1 hour'``) only the row exactly that long ago does.
    """
    def add(d, window):
        held = F.lag(weight, periods).over(window)
        if step is not None:
            expected = F.col(time) - F.expr(f"interval {step}") * periods
            held = F.when(F.lag(time, periods).over(window) == expected, held)
        return d.withColumn(name, held)

    return with_lookback(weights, [*config, entity], [time], periods, add, hot)


def turnover(
    weights: DataFrame, time: str, entity: str, weight: str, config: Sequence[str] = (), hot: Hot = AUTO
) -> DataFrame:
    """Sum over entities of the absolute weight change, per time; before the first row all is 0."""
    moved = lag_weights(weights, time, entity, weight, "_before", config=config, hot=hot)
    change = F.abs(F.coalesce(F.col(weight), F.lit(0.0)) - F.coalesce(F.col("_before"), F.lit(0.0)))
    return moved.groupBy(*config, time).agg(F.sum(change).alias("turnover"))
