"""Per-entity window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.catalog.registry import query
from statloom.operators import windows as wn
from statloom.operators.rolling import rolling, rolling_z
from statloom.sources.files import load_table

EV = "PARTITION BY user_id ORDER BY ts, event_id"
BY, ORDER = ["user_id"], ["ts", "event_id"]
GAPPY = "CASE WHEN value > 30 THEN value END"


def events(spark, d, *extra):
    ev = load_table(spark, d, "events", ["event_id", "ts", "user_id", "value", *extra])
    return ev.withColumn("gappy", F.when(F.col("value") > 30, F.col("value")))


@query(
    "numbered_rows",
    "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS season_no FROM orders",
)
def numbered_rows(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    return wn.number_rows(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "season_no").drop("o_orderdate")


@query(
    "cumulative_sums",
    """SELECT o_orderkey, sum(o_totalprice) OVER w AS total_to_date, CAST(count(*) OVER w AS BIGINT) AS n_to_date FROM orders
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""",
    "total_to_date",
    4,
)
def cumulative_sums(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    out = wn.running_totals(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"total_to_date": "o_totalprice", "n_to_date": F.lit(1)}
    )
    return out.select("o_orderkey", "total_to_date", "n_to_date")


@query(
    "prior_averages",
    """WITH r AS (SELECT *, row_number() OVER w AS n, sum(o_totalprice) OVER w - o_totalprice AS before,
                         sum(year(o_orderdate)) OVER w AS weight_upto FROM orders
                  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))
       SELECT o_orderkey, CASE WHEN n > 1 THEN before / (n - 1) ELSE 0 END AS mean_before, before / weight_upto AS rate_before FROM r""",
    "mean_before rate_before",
    4,
)
def prior_averages(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    by, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    orders = orders.withColumn("year", F.year("o_orderdate"))
    out = wn.prior_average(orders, by, order, {"mean_before": "o_totalprice"})
    out = wn.prior_average(out, by, order, {"rate_before": "o_totalprice"}, weight="year", inclusive_weight=True)
    return out.select("o_orderkey", "mean_before", "rate_before")


@query(
    "trailing_averages",
    f"""SELECT event_id, CASE WHEN count(value) OVER w3 = 3 THEN avg(value) OVER w3 END AS value_avg_L3,
               CASE WHEN count(gappy) OVER w2 = 2 THEN avg(gappy) OVER w2 END AS gappy_avg_L2
        FROM (SELECT *, {GAPPY} AS gappy FROM events) WINDOW w3 AS ({EV} ROWS 2 PRECEDING), w2 AS ({EV} ROWS 1 PRECEDING)""",
    "value_avg_L3 gappy_avg_L2",
)
def trailing_averages(spark, d):
    out = wn.trailing_average(events(spark, d), BY, ORDER, ["value"], 3)
    out = wn.trailing_average(out, BY, ORDER, ["gappy"], 2)
    return out.select("event_id", "value_avg_L3", "gappy_avg_L2")


@query(
    "previous_values",
    f"""SELECT event_id, lag(value, 1) OVER w AS value_prev1, lag(value, 2) OVER w AS value_prev2, lag(gappy, 1) OVER w AS gappy_prev1,
               lag(gappy, 2) OVER w AS gappy_prev2 FROM (SELECT *, {GAPPY} AS gappy FROM events) WINDOW w AS ({EV})""",
)
def previous_values(spark, d):
    out = wn.shifted(events(spark, d), BY, ORDER, ["value", "gappy"], (1, 2))
    return out.select("event_id", "value_prev1", "value_prev2", "gappy_prev1", "gappy_prev2")


@query(
    "season_to_date_by_supplier",
    """WITH g AS (SELECT l_suppkey, l_orderkey, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS rush,
                         count(*) FILTER (WHERE l_returnflag = 'A') AS comp, count(*) AS att FROM lineitem GROUP BY 1, 2)
       SELECT l_suppkey, l_orderkey, avg(rush) OVER w AS rush_avg, sum(comp) OVER w / sum(att) OVER w AS comp_share,
              CAST(sum(att) OVER w AS BIGINT) AS plays FROM g
       WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey ROWS UNBOUNDED PRECEDING)""",
    "rush_avg comp_share",
)
def season_to_date_by_supplier(spark, d):
    li = load_table(spark, d, "lineitem", ["l_suppkey", "l_orderkey", "l_returnflag", "l_quantity"])
    games = li.groupBy("l_suppkey", "l_orderkey").agg(
        F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("rush"),
        F.count_if(F.col("l_returnflag") == "A").alias("comp"),
        F.count(F.lit(1)).alias("att"),
    )
    out = wn.expanding(
        games, ["l_suppkey"], ["l_orderkey"], means={"rush_avg": "rush"}, totals={"plays": "att"}, ratios={"comp_share": ("comp", "att")}
    )
    return out.drop("rush", "comp", "att")


@query(
    "game_to_date_by_order",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) OVER w AS rush_avg,
              sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) OVER w / count(*) OVER w AS comp_share FROM lineitem
       WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)""",
    "rush_avg comp_share",
)
def game_to_date_by_order(spark, d):
    li = load_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity"])
    flag = F.col("l_returnflag")
    out = wn.expanding(
        li,
        ["l_orderkey"],
        ["l_linenumber", "l_partkey", "l_suppkey"],
        means={"rush_avg": F.when(flag == "R", F.col("l_quantity"))},
        ratios={"comp_share": (F.when(flag == "A", 1).otherwise(0), F.lit(1))},
    )
    return out.drop("l_returnflag", "l_quantity")


@query(
    "filled_forward",
    f"""SELECT event_id, last_value(gappy IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS in_user,
               last_value(gappy IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS overall
        FROM (SELECT *, {GAPPY} AS gappy FROM events)""",
)
def filled_forward(spark, d):
    ev = events(spark, d).withColumns({"in_user": F.col("gappy"), "overall": F.col("gappy")})
    out = wn.forward_fill(ev, BY, ORDER, ["in_user"])
    return wn.forward_fill(out, [], ["event_id"], ["overall"]).select("event_id", "in_user", "overall")


@query(
    "quartiles_in_group",
    """WITH v AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer)
       SELECT c_custkey, CASE WHEN bal IS NOT NULL THEN CAST(ntile(4) OVER (PARTITION BY c_mktsegment, bal IS NOT NULL ORDER BY bal, c_custkey) AS INTEGER) END AS quartile FROM v""",
)
def quartiles_in_group(spark, d):
    cust = load_table(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    cust = cust.withColumn("bal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return wn.quantile_bucket(cust, ["c_mktsegment"], "bal", ["c_custkey"], 4, "quartile").select("c_custkey", "quartile")


@query(
    "form_before_game",
    """WITH g AS (SELECT event_id, user_id, ts, value, date_trunc('week', ts) AS wk FROM events)
       SELECT event_id, coalesce(avg(value) OVER (PARTITION BY user_id, wk ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS value_agg,
              avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l5_value,
              avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS l30_value FROM g""",
    "value_agg l5_value l30_value",
)
def form_before_game(spark, d):
    from statloom.plans.gamepoints import player_form

    logs = events(spark, d).withColumn("season", F.date_trunc("week", F.col("ts").cast("timestamp")))
    out = player_form(logs, "user_id", ORDER, ["value"])
    return out.select("event_id", "value_agg", "l5_value", "l30_value")


def _rolling_sql(size: int, need: int) -> str:
    return f"""SELECT event_id, CASE WHEN count(x) OVER w >= {need} THEN avg(x) OVER w END AS mean,
        CASE WHEN count(x) OVER w >= {max(need, 2)} THEN stddev_samp(x) OVER w END AS std,
        CASE WHEN count(*) OVER w >= {need} THEN covar_samp(y, x) OVER w / var_samp(x) OVER w END AS beta,
        CASE WHEN count(*) OVER w >= {need} THEN covar_samp(y, x) OVER w / (stddev_samp(x) OVER w * stddev_samp(y) OVER w) END AS corr
        FROM (SELECT *, value AS x, sqrt(value) + minute(ts) / 10.0::DOUBLE AS y FROM events) WINDOW w AS ({EV} ROWS {size - 1} PRECEDING)"""


def _rolling(spark, d, size: int):
    ev = events(spark, d).withColumn("x", F.col("value"))
    ev = ev.withColumn("y", F.sqrt("value") + F.minute("ts") / 10.0)
    out = rolling(
        ev, BY, ORDER, size, means={"mean": "x"}, stds={"std": "x"}, betas={"beta": ("y", "x")}, correlations={"corr": ("y", "x")}
    )
    return out.select("event_id", "mean", "std", "beta", "corr")


@query("rolling_short", _rolling_sql(5, 5), "mean std beta corr")
def rolling_short(spark, d):
    return _rolling(spark, d, 5)


@query("rolling_medium", _rolling_sql(20, 20), "mean std beta corr")
def rolling_medium(spark, d):
    return _rolling(spark, d, 20)


@query("rolling_by_prefix_sums", _rolling_sql(70, 70), "mean std beta corr")
def rolling_by_prefix_sums(spark, d):
    return _rolling(spark, d, 70)


@query(
    "rolling_partial_windows",
    f"""SELECT event_id, CASE WHEN count(gappy) OVER w >= 1 THEN avg(gappy) OVER w END AS mean
        FROM (SELECT *, {GAPPY} AS gappy FROM events) WINDOW w AS ({EV} ROWS 71 PRECEDING)""",
    "mean",
)
def rolling_partial_windows(spark, d):
    return rolling(events(spark, d), BY, ORDER, 72, means={"mean": "gappy"}, min_periods=1).select("event_id", "mean")


@query(
    "rolling_z_scores",
    f"""SELECT event_id, CASE WHEN count(value) OVER w >= 20 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END AS z
        FROM events WINDOW w AS ({EV} ROWS 19 PRECEDING)""",
    "z",
)
def rolling_z_scores(spark, d):
    return rolling_z(events(spark, d), BY, ORDER, "value", 20).select("event_id", "z")


@query(
    "simple_returns",
    "SELECT o_orderkey, o_totalprice / lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ret FROM orders",
    "ret",
)
def simple_returns(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    return wn.simple_return(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", "ret")


@query(
    "daily_curve",
    """WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1)
       SELECT day, total, sum(total) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS upto FROM s""",
    "total upto",
    2,
)
def daily_curve(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderdate", "o_totalprice"])
    days = orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    return wn.curve(days, ["day"], {"upto": "total"})
