"""Frequent name keys, large membership and laid-out tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from statloom.catalog.landed import laid_out_orders
from statloom.functions.text import jaro
from statloom.operators import fuzzy
from statloom.operators.fuzzy import similar_pairs
from statloom.operators.project import one_of, one_of_many
from statloom.sources.files import write_laid_out
from tests.conftest import SMALL


def names(rng, n, prefix=""):
    return sorted({prefix + "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9))) for _ in range(n)})


def brute(left, right, most):
    return sorted((a, b) for a in left for b in right if a and b and 1 - jaro(a, b) <= most + 1e-12)


def found(spark, left, right, most):
    l = spark.createDataFrame([(x,) for x in left], "x string")
    r = spark.createDataFrame([(x,) for x in right], "y string")
    return sorted((p["name_l"], p["name_r"]) for p in similar_pairs(l, r, ("x", "y"), max_distance=most).collect())


@pytest.mark.parametrize("block", ["2", "2000"])
def test_frequent_keys_are_met_in_blocks(spark, block):
    rng = random.Random(1)
    left, right = names(rng, 60, "Van der "), names(rng, 60, "Van der ")
    right += [x[:-1] + "z" for x in left[:20]] + ["", "a", "ab"]
    spark.conf.set(fuzzy.BLOCK_CONF, block)
    try:
        assert found(spark, left + ["", "ab", None], right + [None], 0.2) == brute(left + ["ab"], right, 0.2)
    finally:
        spark.conf.unset(fuzzy.BLOCK_CONF)


def test_blocks_hold_few_names(spark):
    spark.conf.set(fuzzy.BLOCK_CONF, "10")
    try:
        l = spark.range(200).select(F.concat(F.lit("n"), "id").alias("name_l"), F.lit(1).alias("_key"))
        r = spark.range(55).select(F.concat(F.lit("m"), "id").alias("name_r"), F.lit(1).alias("_key"))
        a, b = fuzzy._in_blocks(l, r, ["_key"])
        met = a.join(b, ["_key", "_lp", "_rp"])
        assert met.count() == 200 * 55 and met.select("name_l", "name_r").distinct().count() == 200 * 55
        pieces = met.groupBy("_lp", "_rp").count().agg(F.max("count"), F.count("*")).first()
        assert pieces[0] <= 25 * 25 and pieces[1] == 20 * 6
    finally:
        spark.conf.unset(fuzzy.BLOCK_CONF)


def test_shared_prefix_is_in_no_key(spark):
    """Letters that all names share come last, so keys stay about as selective as without them."""
    rng = random.Random(2)
    own = names(rng, 400)

    def largest(prefix):
        df = spark.createDataFrame([(prefix + x,) for x in own], "n string").withColumn("_el", fuzzy._occurrences(F.col("n")))
        common = fuzzy._common_first(df)
        keyed = df.select(F.explode(F.array_distinct(fuzzy._keys(fuzzy._rare_first(F.col("_el"), common), 1.4, 3))).alias("k"))
        counts = keyed.groupBy("k").count()
        return counts.agg(F.max("count"), F.median("count")).first()

    with_prefix = largest("Qu'")
    assert with_prefix[0] < 400 / 2, with_prefix


# --- membership ------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_membership_equals_the_semi_join(spark, kind):
    rows = spark.range(5000).select((F.col("id") % 1700).cast(kind).alias("k"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], rows.schema))
    members = spark.range(0, 900, 3).select(F.col("id").cast(kind).alias("m")).unionByName(spark.createDataFrame([(None,)], f"m {kind}"))
    members = members.unionByName(members)
    want = sorted(r["id"] for r in one_of(rows, "k", members).collect())
    assert sorted(r["id"] for r in one_of_many(rows, "k", members).collect()) == want and len(want) > 500


def test_most_rows_are_dropped_before_the_join(spark, tmp_path):
    spark.range(20_000).select(F.col("id").alias("k")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    members = spark.range(0, 20_000, 100).select(F.col("id").alias("m"))
    joined = one_of_many(rows, "k", members)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "subquery" in plan and "LeftSemi" in plan
    lines = plan.splitlines()
    join_at = next(i for i, x in enumerate(lines) if "LeftSemi" in x)
    assert any("Filter" in x and "subquery" in x for x in lines[join_at:])
    assert joined.count() == 200


def test_empty_members(spark):
    rows = spark.range(50).select(F.col("id").alias("k"))
    assert one_of_many(rows, "k", rows.limit(0)).count() == 0
    assert one_of_many(rows.limit(0), "k", rows).count() == 0


# --- laid-out tables -------------------------------------------------------------------------------


def test_laid_out_tables_are_read_where_they_lie(spark):
    orders, customers = laid_out_orders(spark, SMALL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        window = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        summed = orders.withColumn("spent", F.sum("o_totalprice").over(window))
        joined = orders.join(customers, "o_custkey")
        for df in (summed, joined):
            df.collect()
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        plain = spark.read.parquet(f"{SMALL}/orders.parquet")
        assert sorted(map(tuple, orders.collect()), key=str) == sorted(map(tuple, plain.select(*orders.columns).collect()), key=str)
        totals = plain.withColumn("spent", F.sum("o_totalprice").over(window)).select("o_orderkey", "spent")
        got = {r["o_orderkey"]: r["spent"] for r in summed.collect()}
        assert got == pytest.approx({r["o_orderkey"]: r["spent"] for r in totals.collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_laid_out_names_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(None, 2), ("a", 1), ("a", 0)], "e string, t int")
    out = write_laid_out(df, ["e"], ["t"], 3, str(tmp_path / "x"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert write_laid_out(df.limit(0), ["e"], ["t"], 3, str(tmp_path / "y")).count() == 0
