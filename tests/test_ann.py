"""Approximate neighbours: recall against brute force, whole results, repeated points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators.ann import approximate_nearest, recall
from statloom.operators.knn import nearest


def points(spark, x, segments=None, name="id"):
    n, f = x.shape
    segments = ["a"] * n if segments is None else segments
    rows = [(s, i, *map(float, r)) for i, (s, r) in enumerate(zip(segments, x))]
    return spark.createDataFrame(rows, f"seg string, {name} long, " + ", ".join(f"f{j} double" for j in range(f))), [f"f{j}" for j in range(f)]


@pytest.mark.parametrize("shape", ["normal", "clusters", "heavy tail"])
def test_recall_on_six_features(spark, shape):
    rng = np.random.default_rng(11)
    x = {
        "normal": lambda n: rng.normal(size=(n, 6)),
        "clusters": lambda n: rng.integers(0, 5, size=(n, 6)) * 4.0 + rng.normal(size=(n, 6)) * 0.2,
        "heavy tail": lambda n: rng.standard_t(2, size=(n, 6)),
    }[shape]
    pool, features = points(spark, x(3600), ["a"] * 3000 + ["b"] * 600)
    asking, _ = points(spark, x(90), ["a"] * 60 + ["b"] * 30, "subject")
    options = dict(tables=12, probes=9, bucket_rows=512)
    found = approximate_nearest(asking, pool, ["seg"], features, 5, "subject", "id", **options)
    exact = nearest(asking, pool, ["seg"], features, 5, "subject", "id")
    measured = {r["seg"]: (r["n"], r["recall"]) for r in recall(found, exact, ["seg"], "subject").collect()}
    assert measured["a"][0] == 300 and measured["b"][0] == 150
    assert min(r for _, r in measured.values()) >= 0.9, measured
    assert found.groupBy("subject").count().where("count <> 5").count() == 0
    assert found.where("distance < 0 or distance is null").count() == 0


def test_distances_and_order_are_exact(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(900, 2)), rng.normal(size=(40, 2))
    pool, features = points(spark, x)
    asking, _ = points(spark, y, name="subject")
    rows = approximate_nearest(asking, pool, ["seg"], features, 3, "subject", "id", bucket_rows=64).collect()
    assert len(rows) == 120
    for r in rows:
        assert r["distance"] == pytest.approx(np.linalg.norm(x[r["id"]] - y[r["subject"]]), rel=1e-12)
    for i in range(40):
        own = sorted((r["position"], r["distance"], r["id"]) for r in rows if r["subject"] == i)
        assert [p for p, *_ in own] == [1, 2, 3] and [d for _, d, _ in own] == sorted(d for _, d, _ in own)


def test_subjects_far_from_every_bucket_are_searched_exactly(spark):
    x = np.concatenate([np.random.default_rng(3).normal(size=(800, 2)), [[60.0, 60.0]]])
    pool, features = points(spark, x)
    asking, _ = points(spark, np.array([[59.0, 59.0], [-80.0, 90.0]]), name="subject")
    found = approximate_nearest(asking, pool, ["seg"], features, 4, "subject", "id", tables=1, probes=1, bucket_rows=16)
    exact = nearest(asking, pool, ["seg"], features, 4, "subject", "id")
    key = lambda r: (r["subject"], r["position"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, exact.collect()), key=str)


def test_repeated_points_missing_features_and_small_segments(spark):
    x = np.zeros((600, 2))
    pool, features = points(spark, x, ["hot"] * 597 + ["tiny"] * 3)
    pool = pool.unionByName(spark.createDataFrame([("hot", 9999, None, 1.0), (None, 5000, 0.0, 0.0)], pool.schema))
    asking = spark.createDataFrame([("hot", 1, 0.0, 0.0), ("tiny", 2, 1.0, 0.0), (None, 3, 3.0, 4.0), ("hot", 4, None, 0.0), ("none", 5, 0.0, 0.0)], "seg string, subject long, f0 double, f1 double")
    rows = approximate_nearest(asking, pool, ["seg"], features, 5, "subject", "id", bucket_rows=10, block_rows=50).collect()
    own = {}
    for r in sorted(rows, key=lambda r: (r["subject"], r["position"])):
        own.setdefault(r["subject"], []).append((r["id"], r["distance"]))
    assert own == {1: [(i, 0.0) for i in range(5)], 2: [(i, 1.0) for i in (597, 598, 599)]}


def test_empty_sides(spark):
    pool, features = points(spark, np.zeros((3, 2)))
    asking, _ = points(spark, np.zeros((2, 2)), name="subject")
    assert approximate_nearest(asking.limit(0), pool, ["seg"], features, 2, "subject", "id").collect() == []
    assert approximate_nearest(asking, pool.limit(0), ["seg"], features, 2, "subject", "id").collect() == []


def test_searches_do_not_multiply_with_the_table(spark, monkeypatch):
    """Twice the candidates are at most a little more than twice the compared pairs; results equal brute force."""
    from statloom.operators import knn

    met = []
    plain = knn.closest_in_cells

    def counted(visits, placed, segment, cells, *more, **named):
        sizes = placed.groupBy(*cells).agg(F.count(F.lit(1)).alias("_size"))
        met.append(visits.join(sizes, cells).agg(F.sum("_size")).collect()[0][0] or 0)
        return plain(visits, placed, segment, cells, *more, **named)

    monkeypatch.setattr(knn, "closest_in_cells", counted)
    rng = np.random.default_rng(5)
    work = {}
    for n in (8000, 16000):
        x, y = rng.normal(size=(n, 3)), rng.normal(size=(n // 10, 3))
        pool, features = points(spark, x)
        asking, _ = points(spark, y, name="subject")
        met.clear()
        got = knn.nearest(asking, pool, ["seg"], features, 4, "subject", "id", min_cell_rows=64).collect()
        work[n] = sum(met)
        gaps = np.linalg.norm(y[:, None] - x[None], axis=2)
        want = np.argsort(gaps, axis=1, kind="stable")[:, :4]
        have = {(r["subject"], r["position"]): (r["id"], r["distance"]) for r in got}
        assert len(have) == len(y) * 4
        for i, ids in enumerate(want):
            assert [have[i, p + 1][0] for p in range(4)] == ids.tolist()
            assert [have[i, p + 1][1] for p in range(4)] == pytest.approx(gaps[i, ids].tolist(), rel=1e-12)
    assert work[16000] < 2.6 * work[8000], work


def test_candidates_at_one_point_and_repeated_subjects(spark):
    """Copies of a point beyond the k first by id are not dealt out; a repeated subject shares its k places."""
    rng = np.random.default_rng(6)
    x = np.concatenate([np.zeros((3000, 2)), rng.normal(size=(3000, 2))])
    pool, features = points(spark, x)
    asking = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 0.5, 0.5), ("a", 2, 0.5, 0.5), ("a", 2, 3.0, 3.0)], "seg string, subject long, f0 double, f1 double")
    rows = nearest(asking, pool, ["seg"], features, 3, "subject", "id", min_cell_rows=32).collect()
    own = {}
    for r in sorted(rows, key=lambda r: (r["subject"], r["position"])):
        own.setdefault(r["subject"], []).append((r["id"], round(r["distance"], 12)))
    assert own[1] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    pairs = sorted((round(float(np.linalg.norm(x[i] - p)), 12), i) for p in ([0.5, 0.5], [0.5, 0.5], [3.0, 3.0]) for i in range(6000))
    assert own[2] == [(i, d) for d, i in pairs[:3]]
