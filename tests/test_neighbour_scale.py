"""Neighbour searches do not compare or carry more than they need."""

import numpy as np
import pytest

from statloom.operators import knn


def brute(x, at, k, radius=None):
    squares = np.zeros((len(x), len(at)))
    for f in range(x.shape[1]):
        squares += (x[:, f][:, None] - at[:, f]) ** 2
    gaps = np.sqrt(squares)
    first = np.argsort(gaps, axis=1, kind="stable")[:, :k]
    return [(i, int(j), gaps[i, j]) for i, js in enumerate(first) for j in js if radius is None or gaps[i, j] <= radius[i]]


@pytest.mark.parametrize("n, d, ties", [(700, 2, True), (900, 6, False), (3, 3, False), (1, 1, False)])
@pytest.mark.parametrize("bounded", [False, True])
def test_closest_points_match_brute_force(monkeypatch, n, d, ties, bounded):
    monkeypatch.setattr(knn, "LEAF_ROWS", 16)
    monkeypatch.setattr(knn, "CHUNK_PAIRS", 200)
    monkeypatch.setattr(knn, "HELD_PAIRS", 300)
    rng = np.random.default_rng(n)
    x, at = rng.normal(size=(200, d)), rng.normal(size=(n, d))
    if ties:
        x, at = np.round(2 * x), np.round(2 * at)
    radius = np.append(np.abs(rng.normal(size=199)), np.inf) if bounded else None
    row, col, gap = knn.closest_points(x, at, 5, radius)
    assert list(zip(row.tolist(), col.tolist(), gap.tolist())) == brute(x, at, 5, radius)


def test_a_block_does_not_compare_all_its_pairs(monkeypatch):
    compared, within = [], knn.Cells.within

    def counted(cells, root, x, radius):
        row, cell = within(cells, root, x, radius)
        compared.append(len(cell))
        return row, cell

    monkeypatch.setattr(knn.Cells, "within", counted)
    rng = np.random.default_rng(1)
    x, at = rng.normal(size=(500, 3)), rng.normal(size=(16_000, 3))
    knn.closest_points(x, at, 5)
    # of about 100 leaves a row visits few
    assert sum(compared) < 12 * len(x)


def test_contract_table_carries_only_the_career_columns_that_are_read(spark):
    from statloom.catalog import jobs
    from statloom.plans import contracts

    table = jobs.contract_table(spark, "/root/testdata/sf0.001")
    assert {*contracts.RFA_FEATURES, *contracts.UFA_FEATURES, "cap_hit_pct", "nhl_id"} <= set(table.columns)
    assert "career_points" not in table.columns and "points_avg_L3" not in table.columns
