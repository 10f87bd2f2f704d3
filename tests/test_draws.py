"""Keyed draws use every bit of their keys and do not run alongside each other."""

import numpy as np
from pyspark.sql import functions as F

from statloom.functions.scalar import with_uniform
from statloom.operators.simulate import draw_defaults, simulate_losses, with_losses
from tests.conftest import rows


def defaults(spark, loans, kind, trials=500):
    table = spark.createDataFrame([(i, 0.5, 0.5) for i in loans], f"loan {kind}, p1 double, p2 double")
    out = {}
    for r in draw_defaults(table, "loan", ["p1", "p2"], 3, trials).select("loan", "trial", "default_year").collect():
        out.setdefault(r["loan"], {})[r["trial"]] = r["default_year"] == 1
    return {k: np.array([v[t] for t in sorted(v)]) for k, v in out.items()}


def test_ids_far_apart_are_independent(spark):
    got = defaults(spark, [5, 5 + 2**31, 5 + 2**32, 5 + 2**62, -5], "long")
    names = list(got)
    for i, a in enumerate(names):
        assert 0.4 < got[a].mean() < 0.6
        for b in names[:i]:
            assert 0.38 < (got[a] == got[b]).mean() < 0.62


def test_streams_are_not_shifted_copies(spark):
    got = defaults(spark, range(40), "long", 200)
    for i in range(40):
        for j in range(i):
            for shift in (1, 2, 3, 17):
                assert 0.2 < (got[i][shift:] == got[j][:-shift]).mean() < 0.8


def test_text_keys_and_partitioning(spark):
    a = defaults(spark, ["x", "y", "é"], "string")
    assert 0.38 < (a["x"] == a["y"]).mean() < 0.62
    ids = spark.range(1000).withColumn("key", F.col("id"))
    one = with_uniform(ids, "u", 9, "key").orderBy("id").collect()
    two = with_uniform(ids.repartition(7), "u", 9, "key").orderBy("id").collect()
    assert one == two and 0.45 < np.mean([r["u"] for r in one]) < 0.55 and len({r["u"] for r in one}) == 1000


def test_split_plan_does_not_write_out_the_scrambling(spark):
    """No expression of the optimised plan grows with the power of the scrambling steps."""
    from statloom.operators.encode import stratified_split

    rows = spark.range(100).withColumn("label", F.col("id") % 3)
    plan = stratified_split(rows, "label", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert max(map(len, plan.splitlines())) < 2000


def test_losses_are_those_of_single_draws(spark):
    """Totals by trial and group as from one row per loan and trial, and no such row is made."""
    rng = np.random.default_rng(4)
    odd = [(None, 0.5, 0.5, 1.0, 2.0, "a"), (1, None, 0.9, 1.0, 2.0, "a"), (2, 1.0, 0.0, None, 3.0, "only"), (3, float("nan"), 0.1, 7.0, 1.0, None), (2, 0.0, -1.0, 1.0, None, "none")]
    table = [(int(i) - 20, *rng.uniform(0, 0.3, 2).tolist(), *rng.uniform(1, 9, 2).tolist(), "abc"[i % 3]) for i in range(60)] + odd
    loans = spark.createDataFrame(table, "loan long, p1 double, p2 double, e1 double, e2 double, grp string")
    each = with_losses(draw_defaults(loans, "loan", ["p1", "p2"], 3, 300), ["e1", "e2"])
    for by in ([], ["grp"]):
        want = each.groupBy("trial", *by).agg(F.sum("loss").alias("loss"))
        got = simulate_losses(loans, "loan", ["p1", "p2"], ["e1", "e2"], 300, 3, by)
        assert got.schema == want.schema
        assert rows(got) == rows(want)
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_loss_report_reads_written_totals(spark):
    """The pool is drawn once, not again for every figure of the report."""
    from statloom.plans import loanpool

    pool = spark.createDataFrame([(i, 0.3, 10.0 + i) for i in range(20)], "loan long, p double, e double")
    losses = simulate_losses(pool, "loan", ["p"], ["e"], 50, 3)
    for out in (loanpool.loss_report(losses), loanpool.loss_histogram(losses, 5)):
        assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    values = [r["loss"] for r in losses.collect()]
    assert np.isclose(loanpool.loss_report(losses).first()["tail"], np.quantile(values, 0.95))


def test_rows_are_not_shuffled_by_code_or_label(spark):
    """Few codes and cuts: joins on them must not gather all rows of a label in one task."""
    from statloom.operators.encode import code_table, stratified_split, with_code

    table = spark.createDataFrame([(i, "xyz"[i % 3] if i % 10 else None) for i in range(200)], "id long, status string")
    coded = with_code(table, "status", code_table(table, "status"))
    out = stratified_split(coded.filter("code IS NOT NULL"), "code", "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(code" not in plan and "hashpartitioning(status" not in plan
    assert sorted((r["code"], r["n"]) for r in out.filter("is_test").groupBy("code").agg(F.count("*").alias("n")).collect()) == [(0, 12), (1, 12), (2, 12)]
