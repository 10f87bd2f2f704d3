"""Time grid, cross-section, backtest and parameter-sweep queries on an event-price panel.

The panel's symbols are the event types; a price is the average value per bar.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from statloom.catalog.registry import query
from statloom.operators import backtest as bt
from statloom.operators import crosssection as cs
from statloom.operators.aggregate import return_stats
from statloom.operators.timegrid import compound_bars, hourly_bars, regular_grid
from statloom.operators.windows import simple_return
from statloom.plans import strategy
from statloom.sources.files import load_table

BARS_SQL = """bars AS (SELECT date_trunc('hour', ts) AS ts, event_type AS symbol, avg(value) AS close FROM events GROUP BY 1, 2)"""
GRID_SQL = f"""{BARS_SQL},
    span AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars),
    grid AS (SELECT span.ts, s.symbol FROM span CROSS JOIN (SELECT DISTINCT symbol FROM bars) s),
    prices AS (SELECT g.ts, g.symbol, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS price
               FROM grid g LEFT JOIN bars b ON g.ts = b.ts AND g.symbol = b.symbol)"""


def bars(spark, d):
    ev = load_table(spark, d, "events", ["ts", "event_type", "value"]).withColumnRenamed("event_type", "symbol")
    return hourly_bars(ev, "ts", "symbol", "value", 1, "close")


@query("hourly_prices", f"WITH {BARS_SQL} SELECT * FROM bars", "close")
def hourly_prices(spark, d):
    return bars(spark, d)


@query(
    "regular_price_grid",
    f"WITH {GRID_SQL} SELECT g.ts, g.symbol, b.close FROM grid g LEFT JOIN bars b ON g.ts = b.ts AND g.symbol = b.symbol",
    "close",
)
def regular_price_grid(spark, d):
    return regular_grid(bars(spark, d), "ts", "symbol")


@query("filled_prices", f"WITH {GRID_SQL} SELECT * FROM prices", "price")
def filled_prices(spark, d):
    return strategy.price_panel(bars(spark, d))


RETURNS_SQL = f"""{GRID_SQL},
    raw AS (SELECT ts, symbol, price / lag(price) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM prices),
    live AS (SELECT ts FROM raw GROUP BY ts HAVING count(ret) = (SELECT count(DISTINCT symbol) FROM prices)),
    kept AS (SELECT * FROM raw WHERE ts IN (SELECT ts FROM live)),
    rspan AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM kept),
    rets AS (SELECT r.ts, s.symbol, coalesce(k.ret, 0.0) AS ret FROM rspan r CROSS JOIN (SELECT DISTINCT symbol FROM kept) s
             LEFT JOIN kept k ON k.ts = r.ts AND k.symbol = s.symbol)"""


def returns(spark, d):
    return strategy.hourly_returns(strategy.price_panel(bars(spark, d)))


@query("hourly_returns", f"WITH {RETURNS_SQL} SELECT * FROM rets", "ret")
def hourly_returns(spark, d):
    return returns(spark, d)


@query(
    "six_hour_bars",
    f"""WITH {BARS_SQL}, r AS (SELECT ts, symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars),
        s AS (SELECT symbol, ts, lag(ret, 5) OVER (PARTITION BY symbol ORDER BY ts) AS ret FROM r),
        b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS ts, symbol, product(1 + ret) - 1 AS ret FROM s GROUP BY 1, 2),
        span AS (SELECT unnest(generate_series(time_bucket(INTERVAL 6 HOUR, min(ts), TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 6 HOUR, max(ts), TIMESTAMP '2000-01-01'), INTERVAL 6 HOUR)) AS ts FROM bars)
        SELECT span.ts, y.symbol, coalesce(b.ret, 0.0) AS ret FROM span CROSS JOIN (SELECT DISTINCT symbol FROM bars) y
        LEFT JOIN b ON b.ts = span.ts AND b.symbol = y.symbol""",
    "ret",
)
def six_hour_bars(spark, d):
    rets = simple_return(bars(spark, d), ["symbol"], ["ts"], "close").select("ts", "symbol", "ret")
    return compound_bars(rets, "ts", "symbol", "ret", 6)


@query(
    "return_statistics",
    f"""WITH {RETURNS_SQL} SELECT symbol, avg(ret) / stddev_samp(ret) * sqrt(8760) AS sharpe, avg(ret) * 8760 AS annual_return,
        stddev_samp(ret) * sqrt(8760) AS annual_volatility FROM rets GROUP BY 1""",
    "sharpe annual_return annual_volatility",
)
def return_statistics(spark, d):
    return return_stats(returns(spark, d), "ret", strategy.HOURS_PER_YEAR, ["symbol"]).drop("total_return")


@query(
    "compounded_by_month",
    """WITH r AS (SELECT date_trunc('month', o_orderdate) AS m, o_totalprice / lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ret FROM orders)
       SELECT CAST(m AS DATE) AS month, product(1 + ret / 1000) - 1 AS total FROM r GROUP BY 1""",
    "total",
)
def compounded_by_month(spark, d):
    from statloom.operators.aggregate import compounded

    orders = load_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    rets = simple_return(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")
    return rets.groupBy(month).agg(compounded(F.col("ret") / 1000).alias("total"))


@query(
    "rank_with_ties",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN q IS NOT NULL THEN rank() OVER (PARTITION BY l_orderkey ORDER BY q NULLS LAST) + (count(*) OVER (PARTITION BY l_orderkey, q) - 1) / 2.0::DOUBLE END AS rank
       FROM (SELECT *, CASE WHEN l_discount > 0.02 THEN floor(l_quantity / 10) END AS q FROM lineitem)""",
    "rank",
)
def rank_with_ties(spark, d):
    li = load_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"])
    li = li.withColumn("q", F.when(F.col("l_discount") > 0.02, F.floor(F.col("l_quantity") / 10)))
    return cs.average_rank(li, ["l_orderkey"], "q").drop("q", "l_quantity", "l_discount")


@query(
    "unit_gross_weights",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, weight FROM (SELECT *, c / nullif(sum(abs(c)) OVER (PARTITION BY l_orderkey), 0) AS weight FROM c) WHERE weight IS NOT NULL""",
    "weight",
)
def unit_gross_weights(spark, d):
    li = load_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    return cs.demean_and_scale(li, ["l_orderkey"], "l_quantity").drop("l_quantity")


# ---- the strategy ------------------------------------------------------------------------------

BENCH, BETA_W, MA_W, Z_W, LIMIT = "click", 48, 6, 24, 1.0


def _signal_sql(ma: int, z: int, beta: int = BETA_W) -> str:
    return f"""WITH {RETURNS_SQL},
    b AS (SELECT ts, ret AS bench FROM rets WHERE symbol = '{BENCH}'),
    j AS (SELECT r.ts, r.symbol, r.ret, b.bench FROM rets r JOIN b USING (ts) WHERE symbol <> '{BENCH}'),
    res0 AS (SELECT ts, symbol, CASE WHEN count(*) OVER w = {beta} THEN ret - covar_samp(ret, bench) OVER w / var_samp(bench) OVER w * bench END AS resid
             FROM j WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS {beta - 1} PRECEDING)),
    res AS (SELECT * FROM res0 WHERE resid IS NOT NULL),
    ma0 AS (SELECT ts, symbol, CASE WHEN count(*) OVER w = {ma} THEN avg(resid) OVER w END AS ma FROM res WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS {ma - 1} PRECEDING)),
    ma AS (SELECT * FROM ma0 WHERE ma IS NOT NULL),
    z0 AS (SELECT ts, symbol, ma, CASE WHEN count(*) OVER w = {z} THEN (ma - avg(ma) OVER w) / stddev_samp(ma) OVER w END AS z
           FROM ma WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS {z - 1} PRECEDING)),
    sig AS (SELECT ts, symbol, z, ma * z AS signal FROM z0 WHERE z IS NOT NULL)"""


def _book_sql(limit: float, ma: int = MA_W, z: int = Z_W) -> str:
    return f"""{_signal_sql(ma, z)},
    rk AS (SELECT ts, symbol, m, rank() OVER (PARTITION BY ts ORDER BY m) + (count(*) OVER (PARTITION BY ts, m) - 1) / 2.0::DOUBLE AS r
           FROM (SELECT ts, symbol, CASE WHEN abs(z) >= {limit} THEN signal ELSE 0.0 END AS m FROM sig)),
    c AS (SELECT ts, symbol, r - avg(r) OVER (PARTITION BY ts) AS c FROM rk),
    wt AS (SELECT * FROM (SELECT ts, symbol, c / nullif(sum(abs(c)) OVER (PARTITION BY ts), 0) AS weight FROM c) WHERE weight IS NOT NULL),
    held AS (SELECT *, lag(weight) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM wt),
    earned AS (SELECT h.ts, coalesce(sum(before * ret), 0.0) AS ret, sum(abs(weight - coalesce(before, 0))) AS turnover FROM held h LEFT JOIN rets r ON r.ts = h.ts AND r.symbol = h.symbol GROUP BY 1),
    cal AS (SELECT DISTINCT ts FROM rets WHERE ts >= (SELECT min(ts) FROM wt)),
    port AS (SELECT ts, coalesce(ret, 0.0) AS ret, coalesce(turnover, 0.0) AS turnover FROM cal FULL JOIN earned USING (ts))"""


@query("residual_signal", f"{_signal_sql(MA_W, Z_W)} SELECT ts, symbol, z, signal FROM sig", "z signal")
def residual_signal(spark, d):
    resid = strategy.residuals(returns(spark, d), BENCH, BETA_W)
    return strategy.signals(resid, [MA_W], [Z_W]).select("ts", "symbol", "z", "signal")


@query("strategy_weights", f"{_book_sql(LIMIT)} SELECT ts, symbol, weight FROM wt", "weight")
def strategy_weights(spark, d):
    resid = strategy.residuals(returns(spark, d), BENCH, BETA_W)
    return strategy.weights(strategy.signals(resid, [MA_W], [Z_W]), [LIMIT]).select("ts", "symbol", "weight")


@query("strategy_turnover", f"{_book_sql(LIMIT)} SELECT ts, turnover FROM earned", "turnover")
def strategy_turnover(spark, d):
    resid = strategy.residuals(returns(spark, d), BENCH, BETA_W)
    book = strategy.weights(strategy.signals(resid, [MA_W], [Z_W]), [LIMIT])
    return cs.turnover(book, "ts", "symbol", "weight")


@query(
    "strategy_backtest",
    f"{_book_sql(LIMIT)} SELECT ts, ret, turnover, ret - turnover * 0.002 AS net FROM port",
    "ret turnover net",
)
def strategy_backtest(spark, d):
    """Flagship: prices, residual signal, weights, portfolio return and cost."""
    _, series = strategy.backtest(returns(spark, d), BENCH, BETA_W, MA_W, Z_W, LIMIT)
    return series


@query(
    "out_of_sample_backtest",
    f"{_book_sql(LIMIT)} SELECT ts, ret FROM port WHERE ts >= TIMESTAMP '2024-01-20'",
    "ret",
)
def out_of_sample_backtest(spark, d):
    _, series = strategy.backtest(returns(spark, d), BENCH, BETA_W, MA_W, Z_W, LIMIT, first_day=dt.date(2024, 1, 20))
    return series.filter(F.col("ts") >= F.lit(dt.datetime(2024, 1, 20))).select("ts", "ret")


SWEEP = ([4, 6], [12, 24], [0.5, 1.0, 1.5])


def _sweep_sql() -> str:
    parts = []
    for ma in SWEEP[0]:
        for z in SWEEP[1]:
            for t in SWEEP[2]:
                parts.append(
                    f"SELECT * FROM ({_book_sql(t, ma, z)} SELECT {ma} AS ma_window, {z} AS z_window, {t}::DOUBLE AS threshold, avg(ret) / stddev_samp(ret) * sqrt(8760) AS sharpe FROM port)"
                )
    return " UNION ALL ".join(parts)


@query("parameter_sweep", _sweep_sql(), "sharpe")
def parameter_sweep(spark, d):
    return strategy.sweep(returns(spark, d), BENCH, BETA_W, *SWEEP)


@query(
    "alpha_series",
    f"""{_book_sql(LIMIT)}, x AS (SELECT p.ts, p.ret, coalesce(r.ret, 0.0) AS bench FROM port p LEFT JOIN rets r ON r.ts = p.ts AND r.symbol = '{BENCH}')
        SELECT ts, ret, bench, ret - (SELECT regr_slope(ret, bench) FROM x) * bench AS alpha FROM x""",
    "ret bench alpha",
)
def alpha_series(spark, d):
    rets = returns(spark, d)
    _, series = strategy.backtest(rets, BENCH, BETA_W, MA_W, Z_W, LIMIT)
    bench = rets.filter(F.col("symbol") == BENCH).select("ts", F.col("ret").alias("bench"))
    _, alpha = bt.alpha_test(series.select("ts", "ret").join(bench, "ts", "left"), "ts", "ret", "bench")
    return alpha


@query(
    "alpha_statistics",
    f"""{_book_sql(LIMIT)}, x AS (SELECT p.ts, p.ret, coalesce(r.ret, 0.0) AS bench FROM port p LEFT JOIN rets r ON r.ts = p.ts AND r.symbol = '{BENCH}'),
        a AS (SELECT bench, ret - (SELECT regr_slope(ret, bench) FROM x) * bench AS alpha FROM x)
        SELECT avg(alpha) AS alpha_mean, avg(alpha) / stddev_samp(alpha) * sqrt(8760) AS information_ratio, corr(alpha, bench) AS alpha_benchmark_corr FROM a""",
    "alpha_mean information_ratio alpha_benchmark_corr",
)
def alpha_statistics(spark, d):
    rets = returns(spark, d)
    _, series = strategy.backtest(rets, BENCH, BETA_W, MA_W, Z_W, LIMIT)
    bench = rets.filter(F.col("symbol") == BENCH).select("ts", F.col("ret").alias("bench"))
    _, alpha = bt.alpha_test(series.select("ts", "ret").join(bench, "ts", "left"), "ts", "ret", "bench")
    return bt.alpha_stats(alpha, "bench", strategy.HOURS_PER_YEAR)


# ---- the strategy at its own windows and settings --------------------------------------------------

# The events last 30 days: too few hours for windows of 8,760 rows, but enough minutes.
FULL_BETA, FULL_MA, FULL_Z, FULL_LIMIT, PERIODS = 365 * 24, 72, 365 * 12, 3.0, 365 * 24 * 60
FULL_SWEEP = ([60, 72, 84, 96], [365 * z for z in (12, 24, 48, 60)], [2.5, 2.75, 3.0, 3.25, 3.5])


def minute_returns(spark, d):
    ev = load_table(spark, d, "events", ["ts", "event_type", "value"])
    bars = ev.groupBy(F.date_trunc("minute", "ts").alias("ts"), F.col("event_type").alias("symbol")).agg(F.avg("value").alias("close"))
    return strategy.panel_returns(strategy.price_panel(bars, step="1 minute"))


def _full_book_sql(mas, zs, limits) -> str:
    """Weights and portfolio returns of all settings, long form."""
    ma = " UNION ALL ".join(
        f"SELECT {m} AS ma_window, ts, symbol, CASE WHEN count(*) OVER w = {m} THEN avg(resid) OVER w END AS ma FROM res WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS {m - 1} PRECEDING)"
        for m in mas
    )
    z = " UNION ALL ".join(
        f"SELECT ma_window, {z} AS z_window, ts, symbol, ma, CASE WHEN count(*) OVER w = {z} THEN (ma - avg(ma) OVER w) / stddev_samp(ma) OVER w END AS z FROM ma WINDOW w AS (PARTITION BY ma_window, symbol ORDER BY ts ROWS {z - 1} PRECEDING)"
        for z in zs
    )
    at = "ma_window, z_window, threshold"
    return f"""WITH bars AS (SELECT date_trunc('minute', ts) AS ts, event_type AS symbol, avg(value) AS close FROM events GROUP BY 1, 2),
    span AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 MINUTE)) AS ts FROM bars),
    grid AS (SELECT span.ts, s.symbol FROM span CROSS JOIN (SELECT DISTINCT symbol FROM bars) s),
    prices AS (SELECT g.ts, g.symbol, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS price
               FROM grid g LEFT JOIN bars b ON g.ts = b.ts AND g.symbol = b.symbol),
    raw AS (SELECT ts, symbol, price / lag(price) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM prices),
    rets AS (SELECT * FROM raw WHERE ts IN (SELECT ts FROM raw GROUP BY ts HAVING count(ret) = (SELECT count(DISTINCT symbol) FROM prices))),
    j AS (SELECT r.ts, r.symbol, r.ret, b.ret AS bench FROM rets r JOIN rets b ON b.ts = r.ts AND b.symbol = '{BENCH}' WHERE r.symbol <> '{BENCH}'),
    res AS (SELECT * FROM (SELECT ts, symbol, CASE WHEN count(*) OVER w = {FULL_BETA} THEN ret - covar_samp(ret, bench) OVER w / var_samp(bench) OVER w * bench END AS resid
            FROM j WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS {FULL_BETA - 1} PRECEDING)) WHERE resid IS NOT NULL),
    ma AS (SELECT * FROM ({ma}) WHERE ma IS NOT NULL),
    sig AS (SELECT ma_window, z_window, ts, symbol, z, ma * z AS signal FROM ({z}) WHERE z IS NOT NULL),
    masked AS (SELECT ma_window, z_window, threshold, ts, symbol, CASE WHEN abs(z) >= threshold THEN signal ELSE 0.0 END AS m
               FROM sig, (SELECT unnest({list(map(float, limits))}::DOUBLE[]) AS threshold)),
    rk AS (SELECT {at}, ts, symbol, rank() OVER (PARTITION BY {at}, ts ORDER BY m) + (count(*) OVER (PARTITION BY {at}, ts, m) - 1) / 2.0::DOUBLE AS r FROM masked),
    c AS (SELECT {at}, ts, symbol, r - avg(r) OVER (PARTITION BY {at}, ts) AS c FROM rk),
    wt AS (SELECT * FROM (SELECT {at}, ts, symbol, c / nullif(sum(abs(c)) OVER (PARTITION BY {at}, ts), 0) AS weight FROM c) WHERE weight IS NOT NULL),
    held AS (SELECT *, lag(weight) OVER (PARTITION BY {at}, symbol ORDER BY ts) AS before FROM wt),
    earned AS (SELECT {at}, h.ts, coalesce(sum(before * ret), 0.0) AS ret, sum(abs(weight - coalesce(before, 0))) AS turnover
               FROM held h LEFT JOIN rets r ON r.ts = h.ts AND r.symbol = h.symbol GROUP BY {at}, h.ts),
    firsts AS (SELECT {at}, min(ts) AS first FROM wt GROUP BY {at}),
    cal AS (SELECT {at}, t.ts FROM firsts, (SELECT DISTINCT ts FROM rets) t WHERE t.ts >= first),
    port AS (SELECT {at}, ts, coalesce(ret, 0.0) AS ret, coalesce(turnover, 0.0) AS turnover FROM cal FULL JOIN earned USING ({at}, ts))"""


_ONE_FULL_BOOK = _full_book_sql([FULL_MA], [FULL_Z], [FULL_LIMIT])


@query(
    "full_window_backtest",
    f"{_ONE_FULL_BOOK} SELECT ts, ret, turnover, ret - turnover * 0.002 AS net FROM port",
    "ret turnover net",
)
def full_window_backtest(spark, d):
    """The strategy with its windows of 8,760, 72 and 4,380 rows and its threshold of 3, by the minute."""
    _, series = strategy.backtest(minute_returns(spark, d), BENCH, FULL_BETA, FULL_MA, FULL_Z, FULL_LIMIT)
    return series


@query(
    "full_window_alpha",
    f"""{_ONE_FULL_BOOK}, x AS (SELECT p.ts, p.ret, coalesce(r.ret, 0.0) AS bench FROM port p LEFT JOIN rets r ON r.ts = p.ts AND r.symbol = '{BENCH}'),
        a AS (SELECT bench, ret - (SELECT regr_slope(ret, bench) FROM x) * bench AS alpha FROM x)
        SELECT avg(alpha) AS alpha_mean, avg(alpha) / stddev_samp(alpha) * sqrt({PERIODS}) AS information_ratio, corr(alpha, bench) AS alpha_benchmark_corr FROM a""",
    "alpha_mean information_ratio alpha_benchmark_corr",
)
def full_window_alpha(spark, d):
    rets = minute_returns(spark, d)
    _, series = strategy.backtest(rets, BENCH, FULL_BETA, FULL_MA, FULL_Z, FULL_LIMIT)
    bench = rets.filter(F.col("symbol") == BENCH).select("ts", F.col("ret").alias("bench"))
    _, alpha = bt.alpha_test(series.select("ts", "ret").join(bench, "ts", "left"), "ts", "ret", "bench")
    return bt.alpha_stats(alpha, "bench", PERIODS)


@query(
    "full_parameter_sweep",
    f"{_full_book_sql(*FULL_SWEEP)} SELECT ma_window, z_window, threshold, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt({PERIODS}) AS sharpe FROM port GROUP BY 1, 2, 3",
    "sharpe",
)
def full_parameter_sweep(spark, d):
    """All 80 settings, by the minute."""
    return strategy.sweep(minute_returns(spark, d), BENCH, FULL_BETA, *FULL_SWEEP, periods=PERIODS)
