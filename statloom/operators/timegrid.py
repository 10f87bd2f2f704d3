"""Regular time grids and compounded bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.aggregate import compounded
from statloom.operators.windows import shifted

EPOCH = dt.datetime(1970, 1, 1)


def _span(df: DataFrame, time: str) -> tuple[dt.datetime, dt.datetime] | None:
    first, last = df.agg(F.min(time), F.max(time)).first()
    return None if first is None else (first, last)


def _bar_start(time: str | Column, hours: int, first: dt.datetime) -> Column:
    """Start of the ``hours``-long bar; bars are counted from midnight of the first day."""
    midnight = dt.datetime(first.year, first.month, first.day)
    offset = int((midnight - EPOCH).total_seconds()) % (hours * 3600)
    return F.window(time, f"{hours} hours", startTime=f"{offset} seconds").start


def _grid(df: DataFrame, time: str, entity: str, first, last, hours: int, step: str | None = None) -> DataFrame:
    kind = df.schema[time].dataType.simpleString()
    stamps = F.expr(
        f"sequence(cast('{first}' as {kind}), cast('{last}' as {kind}), interval {step or f'{hours} hours'})"
    )
    return df.select(entity).distinct().select(F.explode(stamps).alias(time), entity)


def regular_grid(df: DataFrame, time: str, entity: str, hours: int = 1, step: str | None = None) -> DataFrame:
    """One row per entity and time step between the first and last time of the whole table.

    ``step`` ("1 minute") stands for steps that are not whole hours. Only the first and last timestamps
    reach the driver; the grid itself is generated per entity.
    """
    span = _span(df, time)
    if span is None:
        return df
    grid = _grid(df, time, entity, *span, hours, step)
    return grid.join(df, [time, entity], "left")


def hourly_bars(df: DataFrame, time: str, entity: str, value: str, hours: int = 1, name: str = "price") -> DataFrame:
    """Average value per entity and bar: turns raw observations into a price panel."""
    span = _span(df, time)
    if span is None:
        return df.select(time, entity, F.col(value).alias(name))
    bar = _bar_start(time, hours, span[0]).alias(time)
    return df.groupBy(bar, entity).agg(F.avg(value).alias(name))


def compound_bars(df: DataFrame, time: str, entity: str, value: str, hours: int = 1) -> DataFrame:
    """Compound returns into ``hours``-long bars after delaying them by ``hours - 1`` rows.

    Every bar between the first and last one is present; a bar without rows has return 0.
    """
    span = _span(df, time)
    if span is None:
        return df.select(time, entity, value)
    rows, source = df, value
    if hours > 1:
        rows = shifted(df, [entity], [time], [value], [hours - 1], suffix="_delay")
        source = f"{value}_delay{hours - 1}"
    bars = rows.groupBy(_bar_start(time, hours, span[0]).alias(time), entity).agg(
        compounded(source).alias(value)
    )
    width = dt.timedelta(hours=hours)
    midnight = dt.datetime(span[0].year, span[0].month, span[0].day)
    first, last = (midnight + ((t - midnight) // width) * width for t in span)
    full = _grid(df, time, entity, first, last, hours).join(bars, [time, entity], "left")
    return full.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))
