"""The filter audit against running every order by hand, and its edge cases."""

import math
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from statloom.llm import filter_audit

DOCS = "doc_id long, text string, lang string, id int, part string, fails string, same int, n int, quality int, state int"
LABELS = "doc_id long, quality int, toxic int, text string, id int"


def frames(spark, docs, labels):
    return (
        spark.createDataFrame([(i, t, p, 1, "x", "f", 2, 3, 1, 4) for i, t, p in docs], DOCS),
        spark.createDataFrame([(i, q, x, "t", 9) for i, q, x in labels], LABELS),
    )


def failing(docs):
    out = []
    for i, t, _ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append(
            {
                c
                for c, bad in {
                    "A": len(w) < 200,
                    "B": 100 * len(set(w)) < 50 * len(w),
                    "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                    "D": any(c in "#$%&*|" for c in t),
                    "E": i is not None and any((u or "") == t and j is not None and j < i for j, u, _ in docs),
                }.items()
                if bad
            }
        )
    return out


def brute(docs, labels):
    fails = failing(docs)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for part in {p or "" for *_, p in docs}:
        here = [(i, f) for (i, _, p), f in zip(docs, fails) if (p or "") == part]
        sums, found = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = here
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                sums[c] += len(gone)
                redundant = sum(c in f for _, f in here) - len(gone)
                unique = sum(f == {c} for _, f in here)
                lost = sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)
                found.append((part, "".join(order), step, len(left), len(gone), redundant, unique, *lost, c))
        rows += [(*r[:-1], sums[r[-1]]) for r in found]
    return sorted(rows)


def audited(docs, labels, **options):
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return sorted(tuple(r[n] for n in names) for r in filter_audit.audit(docs, labels, **options).collect())


def random_docs(rng, n):
    kinds = [
        lambda: " ".join(f"w{k}" for k in range(rng.randrange(190, 210))),
        lambda: "a b " * rng.randrange(1, 150),
        lambda: "SHOUT " * rng.randrange(1, 3),
        lambda: rng.choice(["", None, "#", "50% off", "é|É", "x y  z"]),
        lambda: " ".join(f"W{k}" for k in range(250)) + rng.choice(["", " $"]),
    ]
    return [(i, rng.choice(kinds)(), rng.choice(["en", "de", None, ""])) for i in rng.sample(range(1000), n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_every_order_by_hand(spark, seed):
    rng = random.Random(seed)
    docs = random_docs(rng, 150)
    docs += [(1000 + k, rng.choice(docs)[1], "fr") for k in range(40)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, *_ in docs[::2]]
    want = brute(docs, labels)
    assert audited(*frames(spark, docs, labels)) == want
    assert any(r[7] for r in want) and any(r[8] for r in want) and any(r[5] for r in want)


def test_null_ids_repeated_rows_and_labels(spark):
    docs = [(None, "same", "en"), (None, "same", "en"), (5, "same", "en"), (5, "same", "en"), (6, "same", "de"), (6, "other", None), (7, None, "en"), (8, "", "en")]
    labels = [(6, 0, 1), (6, 1, 0), (6, None, None), (None, 1, 1), (99, 1, 1)]
    assert audited(*frames(spark, docs, labels)) == brute(docs, labels)


def test_empty_tables(spark):
    assert audited(*frames(spark, [], [])) == []
    docs = [(1, "a", "en")]
    assert audited(*frames(spark, docs, [])) == brute(docs, [])


def test_very_long_text(spark):
    docs = [(1, "word " * 300_000, "en"), (2, " ".join(f"w{k}" for k in range(60_000)), "en")]
    assert audited(*frames(spark, docs, [])) == brute(docs, [])


def test_lattice_counts_all_orders():
    for n in range(1, 6):
        assert filter_audit.reaching(n)[-1] == filter_audit.leaving(n)[0] == math.factorial(n)
        for f in range(n):
            assert sum(w for _, g, w in filter_audit.edges(n) if g == f) == math.factorial(n)


def test_other_filters(spark):
    docs, labels = frames(spark, [(1, "a", "en"), (2, "b", "en"), (3, "a", "en")], [])
    out = filter_audit.audit(docs, labels, {"X": F.col("text") == "b"}, F.lit(None), copies="Y").collect()
    assert sorted((r["filter_order"], r["step"], r["kept"], r["removed"]) for r in out) == [("XY", 1, 2, 1), ("XY", 2, 1, 1), ("YX", 1, 2, 1), ("YX", 2, 1, 1)]
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, {"E": F.lit(True)})


def test_copies_meet_under_text_and_id(spark):
    """No shuffle is keyed by the text alone once rows are written, but the combined minimum."""
    docs, labels = frames(spark, [(k, "copy", "en") for k in range(50)], [])
    plan = filter_audit.patterns(docs, labels, filter_audit.text_conditions(), F.col("lang"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
