"""The top-k search does not send repeated query blocks to the driver."""

import numpy as np
from pyspark.sql import functions as F

from statloom.llm import topk


def test_repeated_query_blocks_are_not_broadcast(spark, monkeypatch):
    """Spark takes the blocks that are repeated for every bucket for a small table; they must not go to the driver."""
    monkeypatch.setattr(topk, "BUCKET", 16)
    monkeypatch.setattr(topk, "BLOCK", 4)
    plans, search = [], topk._search

    def seen(pairs, k):
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return search(pairs, k)

    monkeypatch.setattr(topk, "_search", seen)
    rng = np.random.default_rng(2)
    v = rng.integers(-64, 64, size=(120, 4)).astype(float)
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.search(table, F.col("vec_id") % 5 == 0, k=3, scale=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    scores = v @ v.T
    assert got == {q: sorted((-int(scores[q, i]), i) for i in range(120) if i != q)[:3] for q in range(0, 120, 5)}
    first, second = plans
    assert "Broadcast" not in second and "SortMergeJoin" in second
