"""Importance resampling against brute force, and its edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from statloom.llm import resampling

DOCS = "doc_id long, text string, row string, n_words int, weight string, rank int, place int"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "r", 1, "w", 2, 3) for i, t in zip(ids, texts)], DOCS)


def targets(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def runs(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def buckets(text):
    return [zlib.crc32(r.encode()) % 10_000 for r in runs(text)]


def brute(ids, texts, target, percent=5):
    s, t = Counter(b for x in texts for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for place, (i, x) in enumerate(zip(ids, texts)):
        found = buckets(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(words(x)), place])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def resampled(spark, docs, target, **options):
    out = resampling.resample(docs, target, **options)
    return sorted(((r["row"]["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in out.collect()), key=str)


def text_of(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


POOL = "the of and in to a is that for It was with Été naïve 42 x_y ΑΒΓ don't <b> İ K".split()


def test_matches_brute_force(spark):
    rng = random.Random(3)
    texts = [text_of(rng, rng.randrange(0, 120), POOL + [f"w{k}" for k in range(rng.randrange(1, 300))]) for _ in range(300)]
    target = [text_of(rng, 60, ["the", "of", "w1", "w2", "w3"]) for _ in range(20)]
    got = resampled(spark, frame(spark, texts), targets(spark, target))
    assert got == brute(range(300), texts, target)
    ranks = sorted(r[4] for r in got if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 10


def test_nulls_ties_and_repeated_rows(spark):
    long = " ".join(f"word{k}" for k in range(40))
    texts = [long] * 30 + [None, "", "one", long, long + " é"] + [long] * 6
    ids = list(range(30)) + [30, 31, 32, None, None] + [7] * 6
    got = resampled(spark, frame(spark, texts, ids).repartition(5), targets(spark, ["word1 word2"]), percent=50)
    want = brute(ids, texts, ["word1 word2"], percent=50)
    assert got == want


@pytest.mark.parametrize("limit", [1, 7, 50])
def test_pieces_give_the_features_of_the_whole(limit):
    rng = random.Random(limit)
    for n in (0, 1, 2, 3, 5, 200):
        text = text_of(rng, n, POOL + ["w" * 90]) + rng.choice(["", " ", "\n"])
        found = list(resampling.features(text.encode(), limit))
        hashes = np.concatenate([h for _, h in found]) if found else []
        assert sorted(hashes) == sorted(zlib.crc32(r.encode()) for r in runs(text))
        assert sum(k for k, _ in found) == len(words(text))


def test_very_long_text(spark):
    texts = ["alpha beta gamma " * 200_000, "alpha " * 30]
    got = resampled(spark, frame(spark, texts), targets(spark, ["alpha beta"]))
    assert [r[1] for r in got] == [3 * 600_000 - 3, 87]


def test_empty_tables(spark):
    assert resampled(spark, frame(spark, []), targets(spark, ["a"])) == []
    assert resampled(spark, frame(spark, ["a " * 30]), targets(spark, [])) == brute([0], ["a " * 30], [])


def test_drawn_documents_keep_their_columns(spark):
    texts = [f"t{k} " * 25 for k in range(40)]
    docs = frame(spark, texts)
    out = resampling.drawn(docs, targets(spark, ["t3 t3 t3"] * 9))
    assert out.columns == docs.columns and [r["rank"] for r in out.collect()] == [2, 2]
    assert {r["doc_id"] for r in out.collect()} <= set(range(40))


def test_the_target_is_preferred(spark):
    rng = random.Random(8)
    near = [text_of(rng, 60, ["sun", "moon", "star", "sky"]) for _ in range(40)]
    far = [text_of(rng, 60, ["tax", "law", "fee", "due"]) for _ in range(360)]
    got = resampled(spark, frame(spark, near + far), targets(spark, ["sun moon star sky " * 20]))
    assert {r[0] for r in got if r[4] is not None} <= set(range(40))


def test_does_not_depend_on_partitions(spark):
    rng = random.Random(9)
    texts = [text_of(rng, 40, POOL) for _ in range(200)]
    target = targets(spark, ["the of and"])
    one = resampled(spark, frame(spark, texts).coalesce(1), target)
    assert one == resampled(spark, frame(spark, texts).repartition(13), target)
