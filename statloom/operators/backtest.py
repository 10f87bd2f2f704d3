"""Portfolio returns from weights, trading cost and the alpha test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.crosssection import Hot, lag_weights, turnover
from statloom.operators.hotgroups import AUTO
from statloom.operators.joins import align_outer, with_choices
from statloom.operators.regress import LinearFit, fit_ols


def portfolio_returns(
    weights: DataFrame,
    returns: DataFrame,
    time: str,
    entity: str,
    weight: str = "weight",
    ret: str = "ret",
    step: str | None = None,
    choices: Sequence[Mapping] = (),
    hot: Hot = AUTO,
) -> DataFrame:
    """Sum over entities of the lagged weight times the return.

    Every time of ``returns`` from the first weight on, and every weight time, is present; times
    without a held weight earn 0. ``choices`` lists the parameter settings whose portfolios the
    weights hold side by side (their names are key columns of ``weights``).
    """
    config = list(choices[0]) if choices else []
    key = [*config, time]
    held = lag_weights(weights.select(*key, entity, weight), time, entity, weight, "_held", 1, step, config, hot)
    earned = (
        held.join(returns.select(time, entity, ret), [time, entity], "left")
        .groupBy(*key)
        .agg(F.coalesce(F.sum(F.col("_held") * F.col(ret)), F.lit(0.0)).alias("ret"))
    )
    times = returns.select(time).distinct()
    if config:
        starts = weights.groupBy(*config).agg(F.min(time).alias("_start"))
        times = with_choices(times, choices).join(starts, config)
    else:
        times = times.withColumn("_start", weights.agg(F.min(time)).scalar())
    calendar = times.filter(F.col(time) >= F.col("_start")).select(*key)
    return align_outer(calendar, earned, key, {"ret": 0.0})


def net_of_costs(
    gross: DataFrame, weights: DataFrame, time: str, entity: str, weight: str = "weight", cost_bps: float = 20.0, hot: Hot = AUTO
) -> DataFrame:
    """Gross series, turnover and the series after ``turnover * cost_bps / 10000``."""
    moved = turnover(weights, time, entity, weight, hot=hot)
    out = align_outer(gross, moved, [time], {"ret": 0.0, "turnover": 0.0})
    return out.withColumn("net", F.col("ret") - F.col("turnover") * (cost_bps * 1e-4))


def alpha_test(series: DataFrame, time: str, ret: str, benchmark: str) -> tuple[LinearFit, DataFrame]:
    """Regress the strategy on the benchmark; the alpha series is constant plus residual."""
    rows = series.withColumn(benchmark, F.coalesce(F.col(benchmark), F.lit(0.0)))
    fit = fit_ols(rows, ret, [benchmark])
    alpha = rows.withColumn("alpha", F.col(ret) - fit.fitted() + fit.coefficients[0])
    return fit, alpha.select(time, ret, benchmark, "alpha")


def alpha_stats(alpha: DataFrame, benchmark: str, periods: float) -> DataFrame:
    """Mean alpha, annualised information ratio, and its correlation with the benchmark."""
    mean, std = F.avg("alpha"), F.stddev_samp("alpha")
    return alpha.agg(
        mean.alias("alpha_mean"),
        (F.try_divide(mean, std) * F.sqrt(F.lit(float(periods)))).alias("information_ratio"),
        F.corr("alpha", benchmark).alias("alpha_benchmark_corr"),
    )
