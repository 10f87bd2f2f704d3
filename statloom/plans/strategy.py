"""Market-residual z-score long/short strategy on an hourly price panel.

The panel is long: one row per (ts, symbol). Steps along time shuffle by symbol, steps across
symbols shuffle by time. Windowed results that later steps read more than once are materialised in
the checkpoint folder, so no step repeats the work of the ones before it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.aggregate import return_stats, to_long
from statloom.operators.backtest import net_of_costs, portfolio_returns
from statloom.operators.crosssection import average_rank, demean_and_scale
from statloom.operators.hotgroups import find_hot
from statloom.operators.joins import lookup, with_choices
from statloom.operators.project import (
    between_days,
    complete_cross_sections,
    drop_incomplete_entities,
    masked,
)
from statloom.operators.rolling import rolling, rolling_means, rolling_zs
from statloom.operators.timegrid import compound_bars, regular_grid
from statloom.operators.windows import forward_fill, simple_return
from statloom.session import cut_lineage

HOURS_PER_YEAR = 365 * 24


def price_panel(bars: DataFrame, price: str = "close", step: str | None = None) -> DataFrame:
    """Prices on a regular grid, hourly or of another ``step``, gaps carried forward."""
    panel = bars.select("ts", "symbol", F.col(price).cast("double").alias("price"))
    return forward_fill(regular_grid(panel, "ts", "symbol", step=step), ["symbol"], ["ts"], ["price"])


def panel_returns(prices: DataFrame) -> DataFrame:
    """Returns from row to row at the times where every symbol has one, whatever the step of the grid."""
    returns = simple_return(prices, ["symbol"], ["ts"], "price", "ret").select("ts", "symbol", "ret")
    return cut_lineage(complete_cross_sections(cut_lineage(returns), "ts", "symbol", "ret"))


def hourly_returns(prices: DataFrame, last_day: dt.date | None = None, hours: int = 1) -> DataFrame:
    """Returns at the times where every symbol has one, compounded into ``hours``-long bars."""
    kept = between_days(prices, "ts", last=last_day)
    returns = simple_return(kept, ["symbol"], ["ts"], "price", "ret").select("ts", "symbol", "ret")
    complete = complete_cross_sections(cut_lineage(returns), "ts", "symbol", "ret")
    return cut_lineage(compound_bars(complete, "ts", "symbol", "ret", hours))


def residuals(returns: DataFrame, benchmark: str, window: int) -> DataFrame:
    """Return minus rolling beta times the benchmark return, for symbols with a full history."""
    bench = returns.filter(F.col("symbol") == benchmark).select("ts", F.col("ret").alias("bench"))
    others = returns.filter(F.col("symbol") != benchmark)
    panel = lookup(others, bench, ["ts"])
    out = rolling(panel, ["symbol"], ["ts"], window, betas={"beta": ("ret", "bench")})
    out = cut_lineage(out.select("ts", "symbol", (F.col("ret") - F.col("beta") * F.col("bench")).alias("resid")))
    live = out.filter(F.col("resid").isNotNull()).select("ts").distinct()
    return drop_incomplete_entities(out.join(live, "ts", "left_semi"), "symbol", "resid")


def signals(
    resid: DataFrame, ma_windows: Sequence[int], z_windows: Sequence[int], min_periods: int | None = None
) -> DataFrame:
    """Smoothed residual, its z-score and their product for every pair of windows, long form
    (ma_window, z_window, ts, symbol, z, signal)."""
    smooth = rolling_means(resid, ["symbol"], ["ts"], "resid", ma_windows, min_periods)
    long = to_long(smooth, ["ts", "symbol"], [f"resid_{m}" for m in ma_windows], "_w", "ma")
    long = long.select(F.substring_index("_w", "_", -1).cast("int").alias("ma_window"), "ts", "symbol", "ma")
    long = complete_cross_sections(cut_lineage(long), "ts", "symbol", "ma", ["ma_window"])
    scored = rolling_zs(long, ["ma_window", "symbol"], ["ts"], "ma", z_windows)
    wide = [f"z_{z}" for z in z_windows]
    out = to_long(scored, ["ma_window", "ts", "symbol", "ma"], wide, "_w", "z")
    out = out.select(
        "ma_window", F.substring_index("_w", "_", -1).cast("int").alias("z_window"), "ts", "symbol", "z",
        (F.col("ma") * F.col("z")).alias("signal"),
    )
    return complete_cross_sections(cut_lineage(out), "ts", "symbol", "z", ["ma_window", "z_window"])


def weights(signal: DataFrame, thresholds: Sequence[float], exclude_masked: bool = False) -> DataFrame:
    """Rank, demean and scale the signal across symbols for every threshold.

    A symbol inside the threshold has signal 0 and still takes part, unless ``exclude_masked``.
    """
    rows = with_choices(signal, [{"threshold": float(t)} for t in thresholds])
    beyond = F.abs("z") >= F.col("threshold")
    value = F.when(beyond, F.col("signal")) if exclude_masked else masked("signal", beyond)
    rows = rows.withColumn("_masked", value)
    at = ["ma_window", "z_window", "threshold", "ts"]
    hot = find_hot(signal, ["ma_window", "z_window", "ts"], "signal")
    ranked = average_rank(rows, at, "_masked", "_rank", hot)
    return cut_lineage(demean_and_scale(ranked, at, "_rank", "weight", hot).select(*at, "symbol", "weight"))


def backtest(
    returns: DataFrame, benchmark: str, beta_window: int, ma_window: int, z_window: int, threshold: float, cost_bps: float = 20.0, min_periods: int | None = None,
    first_day: dt.date | None = None, step: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Weights and the (ts, ret, turnover, net) series of one parameter setting.

    ``first_day`` starts the evaluated returns later than the signal, for out-of-sample periods.
    """
    resid = residuals(returns, benchmark, beta_window)
    held = weights(signals(resid, [ma_window], [z_window], min_periods), [threshold])
    traded = between_days(returns.filter(F.col("symbol") != benchmark), "ts", first=first_day)
    gross = portfolio_returns(held, traded, "ts", "symbol", step=step)
    return held, net_of_costs(gross, held, "ts", "symbol", cost_bps=cost_bps)


def sweep(
    returns: DataFrame, benchmark: str, beta_window: int, ma_windows: Sequence[int], z_windows: Sequence[int], thresholds: Sequence[float], periods: float = HOURS_PER_YEAR
) -> DataFrame:
    """Sharpe ratio of every (ma_window, z_window, threshold); one plan, no loop over jobs."""
    held = weights(signals(residuals(returns, benchmark, beta_window), ma_windows, z_windows), thresholds)
    choices = [
        {"ma_window": m, "z_window": z, "threshold": float(t)} for m, z, t in product(ma_windows, z_windows, thresholds)
    ]
    gross = portfolio_returns(held, returns, "ts", "symbol", choices=choices)
    return return_stats(gross, "ret", periods, list(choices[0])).select(*choices[0], "sharpe")
