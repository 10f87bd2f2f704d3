"""Source and sink queries: driver tables are written in each landed form, read back and summed up."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from statloom.catalog.registry import query
from statloom.session import shared_folder
from statloom.sources import files, schemas


def _place(spark, kind: str) -> str:
    return f"{shared_folder(spark)}/landed-{kind}-{uuid.uuid4().hex}"


@query(
    "csv_loan_pool",
    """SELECT c_custkey AS loan_id, c_mktsegment AS Rating, CAST(c_nationkey AS VARCHAR) || ',' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS Loan_Amount_1Y,
       c_acctbal / 100000 AS Default_Prob_1Y FROM customer""",
    "Default_Prob_1Y",
)
def csv_loan_pool(spark, d):
    """Customers as a loan file with grouped amounts: quoted commas survive the round trip."""
    cust = files.load_table(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"])
    amount = F.concat_ws(",", F.col("c_nationkey").cast("string"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    values = {"loan_id": F.col("c_custkey"), "Rating": F.col("c_mktsegment"), "Loan_Amount_1Y": amount, "Default_Prob_1Y": F.col("c_acctbal") / 100000}
    loans = cust.select(*[values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.LOAN_POOL])
    path = _place(spark, "csv")
    files.write_csv(loans, path)
    return files.read_csv(spark, path, schemas.LOAN_POOL, list(values))


@query(
    "season_json",
    """SELECT o_custkey AS playerId, CAST(year(o_orderdate) * 10000 + year(o_orderdate) + 1 AS INTEGER) AS seasonId,
       CAST(count(*) AS INTEGER) AS gamesPlayed, avg(o_totalprice) AS pointsPerGame FROM orders GROUP BY 1, 2""",
    "pointsPerGame",
)
def season_json(spark, d):
    """Orders per customer and year as season records, one JSON folder per season."""
    orders = files.load_table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    year = F.year("o_orderdate")
    seasons = orders.groupBy(F.col("o_custkey").alias("playerId"), (year * 10000 + year + 1).cast("int").alias("seasonId")).agg(
        F.count(F.lit(1)).cast("int").alias("gamesPlayed"), F.avg("o_totalprice").alias("pointsPerGame")
    )
    path = _place(spark, "json")
    seasons.withColumn("season", F.col("seasonId")).write.partitionBy("season").json(path)
    return files.read_season_json(spark, path, schemas.SKATER_SEASONS).select("playerId", "seasonId", "gamesPlayed", "pointsPerGame")


@query(
    "landed_bars",
    """SELECT event_type AS symbol, date_trunc('hour', ts) AS open_time, max(value) AS high, min(value) AS low, count(*) AS num_trades FROM events GROUP BY 1, 2""",
    "high low",
)
def landed_bars(spark, d):
    """Hourly bars of the events as landed arrays, one line per bar under a folder per symbol."""
    ev = files.load_table(spark, d, "events", ["ts", "event_type", "value"])
    bars = ev.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("at")).agg(
        F.max("value").alias("high"), F.min("value").alias("low"), F.count(F.lit(1)).alias("n")
    )
    ms = F.unix_millis(F.col("at").cast("timestamp")).cast("string")
    cells = {"open_time": ms, "high": F.col("high").cast("string"), "low": F.col("low").cast("string"), "num_trades": F.col("n").cast("string")}
    line = F.to_json(F.array(*[cells.get(f, F.lit(None).cast("string")) for f in files.BAR_FIELDS]))
    path = _place(spark, "bars")
    bars.select("symbol", line.alias("value")).write.partitionBy("symbol").text(path)
    return files.read_bars(spark, path).select("symbol", F.col("open_time").cast("timestamp_ntz"), "high", "low", "num_trades")


@query(
    "parquet_by_flag",
    "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1",
    "quantity",
)
def parquet_by_flag(spark, d):
    """Line items written by flag; only the folders asked for are read."""
    path = _place(spark, "parquet")
    files.write_parquet(files.load_table(spark, d, "lineitem", ["l_returnflag", "l_quantity"]), path, ["l_returnflag"])
    rows = spark.read.parquet(path).filter(F.col("l_returnflag") != "N")
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def laid_out_orders(spark, d):
    """Orders and customers, both dealt by customer into eight buckets."""
    orders = files.load_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    customers = files.load_table(spark, d, "customer", ["c_custkey", "c_mktsegment"]).withColumnRenamed("c_custkey", "o_custkey")
    by, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    return (
        files.write_laid_out(orders, by, order, 8, _place(spark, "orders")),
        files.write_laid_out(customers, by, [], 8, _place(spark, "customers")),
    )


@query(
    "laid_out_totals",
    """SELECT o_orderkey, o_custkey, c_mktsegment, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS spent
       FROM orders JOIN customer ON c_custkey = o_custkey""",
    "spent",
    4,
)
def laid_out_totals(spark, d):
    """Running totals per customer and the customer's segment, without moving a row."""
    orders, customers = laid_out_orders(spark, d)
    spent = F.sum("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    totals = orders.select("o_orderkey", "o_custkey", spent.alias("spent"))
    return totals.hint("merge").join(customers, "o_custkey").select("o_orderkey", "o_custkey", "c_mktsegment", "spent")
