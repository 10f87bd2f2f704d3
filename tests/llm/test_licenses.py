"""The license scan against brute force, and its edge cases."""

import math
import random
import re

import pytest

from statloom.llm import licenses

DOCS = "doc_id long, text string, row string, words string, place int, spans int, start int"
GRANT = next(t for t in licenses.TEMPLATES if t.startswith("permission"))


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "r", "w", 1, 2, 3) for i, t in zip(ids, texts)], DOCS)


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def brute(text, phrases=licenses.PHRASES, templates=licenses.TEMPLATES, least=licenses.LEAST):
    w, spans = words(text), []
    for phrase, label in phrases.items():
        line = phrase.split()
        spans += [(s, s + len(line), label, True, 1.0) for s in range(len(w)) if w[s : s + len(line)] == line]
    for start in range(0, len(w), licenses.STRIDE):
        block = w[start : start + licenses.BLOCK]
        for template, label in templates.items():
            have = set(template.split())
            shared = len(have & set(block))
            if shared >= math.ceil(round(least * len(have), 9)):
                spans.append((start, start + len(block), label, False, shared / len(have)))
    return len(w), sorted(spans)


def scanned(spark, docs, **options):
    out = licenses.scan(docs, **options)
    return sorted(((r["row"]["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]]) for r in out.collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    pool = sorted({w for t in (*licenses.TEMPLATES, *licenses.PHRASES) for w in t.split()})
    texts = []
    for k in range(120):
        parts = [rng.choice(pool + ["zz"] * 40) for _ in range(rng.randrange(0, 160))]
        for _ in range(rng.randrange(0, 3)):
            notice = rng.choice([*licenses.TEMPLATES, *licenses.PHRASES]).split()
            cut = notice[: rng.randrange(len(notice) // 2, len(notice) + 1)]
            if rng.random() < 0.3:
                rng.shuffle(cut)
            at = rng.randrange(0, len(parts) + 1)
            parts[at:at] = cut
        texts.append(rng.choice([" ", ", ", ".\n", "--"]).join(w.upper() if rng.random() < 0.2 else w for w in parts))
    want = sorted(((i, *brute(t)) for i, t in enumerate(texts)), key=str)
    assert scanned(spark, frame(spark, texts)) == want
    assert sum(bool(s) for *_, s in want) > 40


@pytest.mark.parametrize("least", [0.5, 1.0])
def test_other_templates_and_thresholds(spark, least):
    phrases, templates = {"a": "one", "b b": "two"}, {"a b c d": "four", "x": "single"}
    texts = ["a b b b", "c d", "a c x", "b", "d c b a " * 40, "y"]
    want = sorted(((i, *brute(t, phrases, templates, least)) for i, t in enumerate(texts)), key=str)
    assert scanned(spark, frame(spark, texts), phrases=phrases, templates=templates, least=least) == want


def test_edges(spark):
    tail = "Released under\tthe MIT-License"
    texts = [None, "", "  ", tail, tail, "word " * 30_000 + tail, "under the mit licenses", "UNDER THE MIT LICENSE", "LİCENSE under the mıt license", (tail + " ") * 50]
    want = sorted(((i, *brute(t)) for i, t in enumerate(texts)), key=str)
    got = scanned(spark, frame(spark, texts))
    assert got == want
    assert dict((i, s) for i, _, s in got)[5] == [(30_001, 30_005, "mit", True, 1.0)]


def test_kelvin_sign_is_no_k(spark):
    texts = ["for any Kind", "for any Kind"]
    got = scanned(spark, frame(spark, texts), phrases={"any kind": "k"}, templates={})
    assert [len(s) for *_, s in got] == [0, 1]


def test_repeated_rows_null_ids_and_clashing_names(spark):
    texts = [GRANT, GRANT, GRANT, "x"]
    docs = frame(spark, texts, [7, 7, None, None])
    out = licenses.scan(docs).collect()
    assert sorted((str(r["row"]["doc_id"]), len(r["spans"])) for r in out) == [("7", 1), ("7", 1), ("None", 0), ("None", 1)]
    assert set(out[0]["row"].asDict()) == set(docs.columns)
    assert all(s["share"] == 1.0 and s["label"] == "mit" for r in out for s in r["spans"])


def test_empty_table_and_no_templates(spark):
    assert scanned(spark, frame(spark, [])) == []
    assert scanned(spark, frame(spark, ["a b"]), phrases={}, templates={}) == [(0, 2, [])]


def test_long_phrases_are_refused(spark):
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, ["a"]), phrases={" ".join("a" * 40): "x"})


def test_plan_has_no_python(spark):
    plan = licenses.scan(frame(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
