"""Boosted trees on shared bins against a brute-force grower on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import histtrees as ht
from statloom.operators import learn
from statloom.operators.histtrees import Setting

NAMES = ["a", "b", "c"]


def sample(n=240, classes=2, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.uniform(size=n)])
    score = x[:, 0] + 0.6 * x[:, 1] + rng.normal(size=n) * 0.5
    y = np.digitize(score, np.quantile(score, np.arange(1, classes) / classes))
    return x, y, rng.integers(0, 3, n)


def frame(spark, x, y, fold):
    rows = [(i, *map(float, r), int(c), int(f)) for i, (r, c, f) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int, fold int").repartition(4)


def brute(x, y, rounds, depth, rate, classes, cuts, penalty=1.0):
    """Margins after growing each node by trying every cut on every feature."""
    width = 1 if classes == 2 else classes
    margins = np.zeros((len(y), width))
    leaves = []
    for _ in range(rounds):
        e = np.exp(margins - margins.max(axis=1, keepdims=True)) if width > 1 else None
        p = e / e.sum(axis=1, keepdims=True) if width > 1 else 1 / (1 + np.exp(-margins))
        added = np.zeros_like(margins)
        for k in range(width):
            t = (y == (k if width > 1 else 1)).astype(float)
            g, h = p[:, k] - t, np.maximum((2 if width > 1 else 1) * p[:, k] * (1 - p[:, k]), 1e-16)

            def grow(rows, level):
                G, H = g[rows].sum(), h[rows].sum()
                best = (1e-12, None)
                if level < depth:
                    for f in range(x.shape[1]):
                        for c in cuts[f]:
                            left = rows[x[rows, f] <= c]
                            right = rows[x[rows, f] > c]
                            hl, hr = h[left].sum(), h[right].sum()
                            if hl < 1 or hr < 1:
                                continue
                            gain = g[left].sum() ** 2 / (hl + penalty) + g[right].sum() ** 2 / (hr + penalty) - G**2 / (H + penalty)
                            if gain > best[0] + 1e-12:
                                best = (gain, (left, right))
                if best[1] is None:
                    added[rows, k] = -G / (H + penalty) * rate
                else:
                    grow(best[1][0], level + 1)
                    grow(best[1][1], level + 1)

            grow(np.arange(len(y)), 0)
        margins += added
        leaves.append(margins.copy())
    return leaves


def asked(model, df, which=0):
    rows = ht.predicted(model, df, which).select("id", "probabilities", "prediction").collect()
    return {r["id"]: (r["probabilities"], r["prediction"]) for r in rows}


@pytest.mark.parametrize("classes", [2, 3])
def test_matches_brute_force(spark, classes):
    x, y, fold = sample(classes=classes)
    df = frame(spark, x, y, fold)
    bins = ht.find_bins(df, NAMES, 8)
    table = ht.bin_rows(df, bins, "label", "id")
    model = ht.fit(table, bins, [Setting(rounds=4, depth=3, rate=0.3)], 1 if classes == 2 else classes)
    want = ht.probabilities(brute(x, y, 4, 3, 0.3, classes, bins.cuts)[-1])
    got = asked(model, df)
    assert np.allclose([got[i][0] for i in range(len(y))], want, atol=1e-9)
    guess = (want[:, 0] > 0.5).astype(int) if classes == 2 else want.argmax(axis=1)
    assert [got[i][1] for i in range(len(y))] == guess.tolist()
    assert (guess == y).mean() > 0.7


def test_models_grown_together_equal_models_grown_alone(spark, monkeypatch):
    monkeypatch.setattr(ht, "CUT", 2)
    x, y, fold = sample()
    df = frame(spark, x, y, fold)
    bins = ht.find_bins(df, NAMES, 8)
    table = ht.bin_rows(df, bins, "label", "id", "fold")
    settings = [Setting(3, 2, 0.3), Setting(2, 3, 0.1, row_share=0.7), Setting(3, 2, 0.2, left_out=1)]
    together = ht.fit(table, bins, settings)
    for m, s in enumerate(settings):
        if s.row_share < 1:
            continue  # samples depend on the model's place
        alone = ht.fit(table, bins, [s])
        a, b = asked(together, df, m), asked(alone, df)
        assert all(np.allclose(a[i][0], b[i][0]) for i in a)
    # a model that leaves a fold out does not depend on that fold's labels
    flipped = ht.bin_rows(df.withColumn("label", F.when(F.col("fold") == 1, 1 - F.col("label")).otherwise(F.col("label"))), bins, "label", "id", "fold")
    other = ht.fit(flipped, bins, [settings[2]])
    assert all(np.allclose(asked(other, df)[i][0], v[0]) for i, v in asked(together, df, 2).items())


def test_search_scores_match_brute_force(spark):
    x, y, fold = sample()
    df = frame(spark, x, y, fold)
    grid = {"rounds": [1, 3], "depth": [1, 2], "rate": [0.3]}
    got = {r["parameters"]: r["score"] for r in ht.search(df, NAMES, "label", "id", "fold", 3, grid, bins=8).collect()}
    cuts = ht.find_bins(df, NAMES, 8).cuts
    want = {}
    for depth in (1, 2):
        precision = {1: [], 3: []}
        for f in range(3):
            learn = fold != f
            # margins of all rows from trees grown on the others
            stages = staged(x, y, learn, 3, depth, 0.3, cuts)
            for rounds in (1, 3):
                said = (stages[rounds - 1] > 0) & ~learn
                precision[rounds].append((y[said] == 1).mean() if said.any() else 0.0)
        for rounds, p in precision.items():
            want[f"depth={depth}, rate=0.3, rounds={rounds}"] = float(np.mean(p))
    assert got == pytest.approx(want)


def staged(x, y, learn, rounds, depth, rate, cuts):
    """Margins of all rows, learned from some."""
    margin, out = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        added = np.zeros(len(y))

        def grow(rows, level):
            own = rows[learn[rows]]
            G, H = g[own].sum(), h[own].sum()
            best = (1e-12, None)
            for f in range(x.shape[1]) if level < depth else ():
                for c in cuts[f]:
                    left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    l, r = left[learn[left]], right[learn[right]]
                    if h[l].sum() < 1 or h[r].sum() < 1:
                        continue
                    gain = g[l].sum() ** 2 / (h[l].sum() + 1) + g[r].sum() ** 2 / (h[r].sum() + 1) - G**2 / (H + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, (left, right))
            if best[1] is None:
                added[rows] = -G / (H + 1) * rate
            else:
                grow(best[1][0], level + 1), grow(best[1][1], level + 1)

        grow(np.arange(len(y)), 0)
        margin = margin + added
        out.append(margin.copy())
    return out


def test_missing_values_repeated_rows_and_constant_features(spark):
    x, y, fold = sample(60)
    df = frame(spark, x, y, fold).withColumn("b", F.lit(2.0))
    rows = df.unionByName(df).unionByName(spark.createDataFrame([(999, None, 2.0, 0.1, 1, 0), (998, 0.1, 2.0, 0.1, None, 0), (997, float("nan"), 2.0, 0.1, 1, 0)], df.schema))
    bins = ht.find_bins(rows, NAMES, 8)
    table = ht.bin_rows(rows, bins, "label", "id", "fold")
    assert table.count() == 120
    model = ht.fit(table, bins, [Setting(rounds=2, depth=2, column_share=0.5, row_share=0.5)])
    told = ht.scores(model, table)
    assert told.agg(F.sum("n")).first()[0] == 120


def test_empty_table(spark):
    df = frame(spark, *sample(0 + 4)).limit(0)
    bins = ht.Bins(tuple(NAMES), ((0.0,), (1.0,), (0.5,)))
    table = ht.bin_rows(df, bins, "label", "id", "fold")
    model = ht.fit(table, bins, [Setting(rounds=1, depth=1)])
    assert ht.scores(model, table).collect() == []


def test_rows_alike_are_learnt_from_once(spark, monkeypatch):
    """Passes read one row for all that share bins, label and fold; the trees are those of all rows."""
    x, y, fold = sample(120)
    x = np.column_stack([np.round(x[:, 0]), x[:, 1], np.round(x[:, 2])])
    rows = frame(spark, np.tile(x, (5, 1)), np.tile(y, 5), np.tile(fold, 5))
    bins = ht.find_bins(rows, NAMES, 8)
    table = ht.bin_rows(rows, bins, "label", "id", "fold")
    read = []
    level = ht._level
    monkeypatch.setattr(ht, "_level", lambda t, *more: (read.append((t.count(), t.agg(F.sum("n")).collect()[0][0])), level(t, *more))[1])
    settings = [Setting(rounds=2, depth=3, rate=0.3)]
    trees = [ht.fit(table, bins, settings).trees]
    distinct = table.select("bins", "label", "fold").distinct().count()
    assert distinct < 300 and set(read) == {(distinct, 600)}
    monkeypatch.setattr(ht, "DRIVER_BYTES", 0)
    trees.append(ht.fit(table, bins, settings).trees)
    for a, b in zip(*([t for r in grown[0] for t in r] for grown in trees)):
        assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist()
        assert a.value == pytest.approx(b.value, rel=1e-9)


@pytest.mark.parametrize("classes", [1, 3])
def test_models_grown_in_one_task_equal_those_grown_by_passes(spark, monkeypatch, classes):
    x, y, fold = sample(classes=max(2, classes))
    table_rows = frame(spark, np.tile(x, (2, 1)), np.tile(y, 2), np.tile(fold, 2))
    bins = ht.find_bins(table_rows, NAMES, 8)
    table = ht.bin_rows(table_rows, bins, "label", "id", "fold")
    plain = [Setting(4, 3, 0.3), Setting(2, 4, 0.1, left_out=1, column_share=0.5), Setting(3, 2, 0.2, target=0)]
    for settings in (plain, [*plain, Setting(2, 3, 0.1, row_share=0.6)]):
        by_passes = ht.fit(table, bins, settings, classes).trees
        with monkeypatch.context() as patch:
            patch.setattr(ht, "FEW_PASSES", 0)
            patch.setattr(ht, "_level", None)
            in_tasks = ht.fit(table, bins, settings, classes).trees
        assert [len(m) for m in in_tasks] == [s.rounds for s in settings]
        pairs = [(a, b) for one, other in zip(by_passes, in_tasks) for r, q in zip(one, other, strict=True) for a, b in zip(r, q, strict=True)]
        for a, b in pairs:
            assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist()
            assert a.value == pytest.approx(b.value, rel=1e-9) and a.gain == pytest.approx(b.gain, rel=1e-4, abs=1e-6)


def test_grid_has_the_rounds_of_the_reference(spark, monkeypatch):
    """135 fits: 50, 100 and 200 rounds, three rates, three depths, five folds."""
    from statloom.catalog import models

    assert models.GRID == {"rounds": [50, 100, 200], "rate": [0.01, 0.1, 0.2], "depth": [3, 5, 7]}
    asked, none = [], spark.createDataFrame([], "parameters string, score double")
    monkeypatch.setattr(ht, "search", lambda df, *more: (asked.append(more[3:]), none)[1])
    models.boosted_grid_scores(spark, "/root/testdata/sf0.001")
    assert asked == [("fold", 5, models.GRID)]


def test_one_model_a_class_has_the_rounds_of_the_reference(spark, monkeypatch):
    """75 rounds of depth 5 at a rate of 0.075 for every class; all of them are grown."""
    from statloom.catalog import models

    fitted, fit = [], ht.fit
    monkeypatch.setattr(ht, "fit", lambda *more, **named: (fitted.append(fit(*more, **named)), fitted[-1])[1])
    assert models.many_class_scores(spark, "/root/testdata/sf0.001").count() == 1
    (model,) = fitted
    assert [(s.rounds, s.depth, s.rate, s.target) for s in model.settings] == [(75, 5, 0.075, k) for k in range(3)]
    assert [len(trees) for trees in model.trees] == [75] * 3


def test_highest_of_one_model_a_class_wins(spark):
    """Each class is told from the others by the trees of brute force; the highest margin is predicted."""
    x, y, fold = sample(classes=3)
    df = frame(spark, x, y, fold).withColumn("label", F.col("label").cast("double"))
    ready = learn.assemble(df, NAMES)
    model = learn.many_class_boosted_trees(rounds=3, depth=2, rate=0.3).fit(ready)
    cuts = model.boosted.bins.cuts
    want = np.column_stack([brute(x, (y == k).astype(int), 3, 2, 0.3, 2, cuts)[-1][:, 0] for k in range(3)])
    got = {r["id"]: r for r in model.transform(ready).collect()}
    assert np.allclose([got[i]["rawPrediction"].toArray() for i in range(len(y))], want, atol=1e-9)
    assert [got[i]["prediction"] for i in range(len(y))] == want.argmax(axis=1).tolist()
    shares = learn.importances(model, NAMES, df).collect()
    assert sum(r["importance"] for r in shares) == pytest.approx(1) and shares[0]["feature"] in ("a", "b")
    sampled = learn.many_class_boosted_trees(rounds=2, depth=2, rate=0.3, row_share=0.5, column_share=0.5).fit(ready)
    assert [len(trees) for trees in sampled.boosted.trees] == [2, 2, 2]
    with pytest.raises(ValueError):
        learn.many_class_boosted_trees(rounds=2).fit(ready.limit(0))
