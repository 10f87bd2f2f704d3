"""Nulls, empty tables, ties, repeated rows, long texts and clashing extra columns, operator by operator."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statloom.llm import chat, contamination, jaccard, language_model, linedup, mixing, quality, secrets, token_files, topk
from statloom.llm.queries import tokenizer_path
from statloom.llm.recurrent import GatedModel

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _part int, size long, rank int"
LONG = " ".join(f"word{k % 977}" for k in range(40_000))
TEXTS = [None, "", "one", "one", "A b C d e f g", "x\n" * 5, LONG, "é ß ñ. Ü!!"]


def documents(spark, texts=TEXTS, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return spark.createDataFrame(
        [(i, t, None, s, None, 1, 2, 3) for i, t, s in zip(ids, texts, sources)], DOCS
    )


def nothing(spark):
    return spark.createDataFrame([], DOCS)


# --- token files -----------------------------------------------------------------------------------


def round_trip(spark, docs, folder):
    token_files.write(docs, str(folder), tokenizer_path())
    return token_files.read(spark, str(folder)).orderBy("start").collect()


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    texts = [*TEXTS, "don't <|endoftext|> (STOP)!!", "l'été≠ 12,3 ΑΣ. ́x", "İI ſ K '***"]
    rows = round_trip(spark, documents(spark, texts), tmp_path / "files")
    at = 0
    for i, (row, text) in enumerate(zip(rows, texts)):
        want = whole.encode(text or "", add_special_tokens=False).ids + [token_files.END_ID]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids"]) == (i, at, len(want), want)
        at += len(want)
    sums = {r["doc_id"]: r["ids_crc32"] for r in token_files.digests(spark, str(tmp_path / "files")).collect()}
    assert sums[4] == zlib.crc32(np.array(rows[4]["ids"], dtype="<u4").tobytes())


def test_token_files_order_ties_and_empty(spark, tmp_path):
    docs = documents(spark, ["b", "a", "b", "c"], ids=[7, 7, 7, None])
    rows = round_trip(spark, docs, tmp_path / "ties")
    assert [r["doc_id"] for r in rows] == [None, 7, 7, 7]
    assert rows[2]["ids"] == rows[3]["ids"] != rows[1]["ids"]
    assert round_trip(spark, nothing(spark), tmp_path / "none") == []


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24, 2**32 - 1], [7] * 9])
def test_packing(values):
    control, data = token_files.pack([np.array(values, dtype=np.uint32), np.array([1], dtype=np.uint32)])
    both = token_files.unpack(b"".join(control.to_pylist()), b"".join(data.to_pylist()))
    assert both[: len(values)].tolist() == values and both[-4] == 1


# --- contamination ---------------------------------------------------------------------------------


def judged(spark, docs, items, **options):
    benchmark = spark.createDataFrame(items, "item_id long, text string, n_words int")
    return {r["doc_id"]: r["_contamination"] for r in contamination.contamination(docs, benchmark, **options).collect()}


def brute_contamination(text, items, window=13, share=20):
    def words(t):
        return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]

    w, hit, named = words(text), set(), set()
    for item, t in items:
        seq = words(t)
        n = min(window, len(seq))
        for k in range(len(seq) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == seq[k : k + n]:
                    hit |= set(range(p, p + n))
                    named.add(str(item))
    return len(w), len(hit), sorted(named), bool(hit) and share * len(hit) >= len(w)


def test_contamination_matches_brute_force(spark):
    passage = [f"p{k}" for k in range(30)]
    items = [(1, " ".join(passage[:20])), (2, "two, WORDS"), (3, "single"), (4, None), (5, ""), (6, " ".join(passage[5:20])), (7, "aa aa")]
    texts = [
        None,
        "",
        "the single one",
        "some Two  words here " * 3,
        " ".join(["x"] * 400 + passage[3:18]),
        "before " + ", ".join(passage) + " after",
        " ".join(passage[:12]),
        "aa aa aa aa",
        LONG + " " + " ".join(passage),
    ]
    rows = [(i, t, 0) for i, t in items]
    for options in ({}, {"block_bytes": 40}):
        found = judged(spark, documents(spark, texts), rows, **options)
        for i, text in enumerate(texts):
            c = found[i]
            assert (c["n_words"], c["n_hit"], list(c["item_ids"]), c["contaminated"]) == brute_contamination(text, items)


def test_contamination_longest_matches(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    row = contamination.matches(documents(spark, ["z z " + passage + " z"]), benchmark).first()["_match"]
    assert [tuple(m) for m in row["matches"]] == [(2, 20, "1", 0)]


def test_contamination_empty(spark):
    assert judged(spark, nothing(spark), [(1, "a b c", 0)]) == {}
    assert not any(c["contaminated"] for c in judged(spark, documents(spark), []).values())
    kept = contamination.clean(documents(spark), spark.createDataFrame([], "item_id long, text string"))
    assert kept.columns == documents(spark).columns and kept.count() == len(TEXTS)


# --- mixing ----------------------------------------------------------------------------------------


def test_mixing_targets_and_copies(spark):
    sources = ["a"] * 40 + ["b"] * 3 + [None] * 30 + ["z"] * 2
    texts = [" ".join(["w"] * (1 + k % 9)) for k in range(73)] + [None, ""]
    docs = documents(spark, texts, sources=sources)
    sized = docs.select("doc_id", "source", mixing.size_of().alias("size"))
    rows = mixing.copies(sized).collect()
    total = sum(r["size"] for r in rows)
    by = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    assert abs(sum(t for _, t in by.values()) - total) < 1e-6
    # order a, b, z, null with weights 1, 2, 3, 1
    assert by["b"][1] == 3 * by["b"][0] and by["z"] == (0, 0.0)
    assert by["a"][1] == pytest.approx(by[None][1]) or by[None][1] == 3 * by[None][0]
    for name, (size, target) in by.items():
        taken = sum(r["copies"] * r["size"] for r in rows if r["source"] == name)
        assert abs(taken - target) <= 9 and all(0 <= r["copies"] <= 3 for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_mixing_repeated_rows_and_empty(spark):
    docs = documents(spark, ["a b"] * 4, ids=[1, 1, 1, 2])
    sized = docs.select("doc_id", "source", mixing.size_of().alias("size"))
    rows = {r["doc_id"]: r for r in mixing.copies(sized).collect()}
    assert rows[1]["rows"] == 3 and rows[1]["source_size"] == 8
    # many rows alike are taken one by one: the words taken meet the target
    docs = documents(spark, ["a b"] * 60 + ["c d e"] * 40, ids=[None] * 100, sources=["a"] * 60 + ["b"] * 40)
    docs = docs.select("*", *[F.lit(0).alias(c) for c in ("row", "_row", "_copies", "number", "rows", "hash", "_taken_size")])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()} == {"a": 40, "b": pytest.approx(160 / 3, abs=1)}
    assert mixing.mix(nothing(spark)).count() == 0


def test_mixing_shuffles_whole_rows_once(spark, monkeypatch):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"))
    plans, dealt = [], mixing.in_parts

    def in_parts(df, *args):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return dealt(df, *args)

    monkeypatch.setattr(mixing, "in_parts", in_parts)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 1 << 15)
    try:
        mixing.mix(docs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # no row repeats another's key, so the look for such rows must not shuffle them
    (semi,) = [x for x in plans if "LeftSemi" in x]
    assert "BroadcastHashJoin" in semi and "SortMergeJoin" not in semi


# --- line deduplication ----------------------------------------------------------------------------


def brute_lines(texts):
    seen, out = {}, []
    for i, t in enumerate(texts):
        lines = [] if t is None else t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if "".join(w).strip(" "):
                seen.setdefault(w, (i, p))
    for i, t in enumerate(texts):
        if t is None:
            out.append(None)
            continue
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen and seen[w] != (i, p):
                gone |= {p, p + 1, p + 2}
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = ["\n".join(rng.choice(list("abcd "), rng.integers(0, 14))) for _ in range(60)]
    texts += [None, "", "\n\n\n", "a\nb", "q\nr\ns\nt", "q\nr\ns\nt", "\n".join(["same"] * 50), "\n".join(map(str, range(5000)))]
    docs = documents(spark, texts)
    out = linedup.deduplicate(docs)
    assert out.columns == [*docs.columns, "_lines"]
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    assert got == brute_lines(texts)
    assert linedup.deduplicate(nothing(spark)).count() == 0


def test_line_dedup_repeated_rows(spark):
    docs = documents(spark, ["a\nb\nc", "a\nb\nc", "a\nb\nc\nd"], ids=[1, 1, None])
    got = {(r["doc_id"], r["text"]) for r in linedup.deduplicate(docs).collect()}
    assert got == {(None, "a\nb\nc\nd"), (1, "")}


# --- chats -----------------------------------------------------------------------------------------


def test_chats_collapse(spark):
    def chat_rows(conv, *texts):
        return [(conv, k, "user" if k % 2 == 0 else "assistant", t, "x") for k, t in enumerate(texts)]

    rows = (
        chat_rows(1, "hi")
        + chat_rows(2, "hi", "hello")
        + chat_rows(3, "hi", "hello", "bye")
        + chat_rows(4, "hi", "hullo")
        + chat_rows(6, "hi", "hullo")
        + chat_rows(5, "hi", "hello", "bye")
        + [(None, 0, "user", "lost", "x"), (7, None, None, None, "x"), (7, None, None, None, "x"), (8, 3, "<|user|>", "a <|end|> b", "x")]
    )
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.format_chats(table).collect()}
    assert sorted(got) == [3, 4, 7, 8]
    assert got[3] == (3, "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nbye<|end|>\n")
    assert got[7] == (1, "<|unknown|>\n<|end|>\n")
    assert "a < |end|> b" in got[8][1]
    assert chat.format_chats(table.limit(0)).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    docs = documents(spark, ["one two three four"] * 3 + [None])
    docs = docs.select("*", *[F.lit(c).alias(c) for c in ("_score", "__SCORE", "_match", "_contamination", "row")])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([("i", "nine ten")], "item_id string, text string")
    for kept in (quality.keep(docs, labels), contamination.clean(docs, benchmark)):
        assert kept.columns == docs.columns
        assert all(r["_match"] == "_match" and r["_score"] == "_score" for r in kept.collect())


# --- secrets ---------------------------------------------------------------------------------------


def entropy(window):
    counts = np.array([window.count(c) for c in set(window)])
    return float(np.log2(len(window)) - (counts * np.log2(counts)).sum() / len(window))


def test_secret_entropy_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    alphabet = secrets.CLASSES[1][4]
    values = ["".join(rng.choice(list(alphabet[: 4 + 3 * k]), 20 + k)) for k in range(20)]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[1] for r in rows.select("v", secrets.least_cost(F.col("v"), alphabet)).collect()]
    for value, cost in zip(values, got):
        best = max(entropy(value[i : i + 20]) for i in range(len(value) - 19))
        assert np.log2(20) - cost / 20e6 == pytest.approx(best, abs=1e-5)


def test_long_secret_with_allowed_parts(spark):
    rng = np.random.default_rng(8)
    alphabet = list(secrets.CLASSES[1][4])
    long = "".join(rng.choice(alphabet, 20_000))
    texts = [long, long[:400] + "www" + long[400:800], f"/services/T0/B0/{long[:60].replace('/', 'x')}", "/data/" * 400, "example" * 300]
    found = secrets.scan(documents(spark, texts)).select("doc_id", secrets.listed(F.col("_spans"), secrets.KINDS))
    spans = {r[0]: r[1] for r in found.collect()}
    assert spans == {k: f"entropy_mixed:0:{len(t)}" if k < 3 else "" for k, t in enumerate(texts)}


def test_secret_spans(spark):
    key, mixed = "AKIA" + "B7" * 10, "aZ3xQ9mK2pL7vT1wR8yN4c"
    texts = [
        None,
        "",
        'é😀 PassWord = "hunter22" token=abc',
        f"{key} AKIA12",
        "0123456789abcdef01234567 deadbeef",
        f"key {mixed} end",
        f"token: {mixed}",
        "see /usr/lib/x86_64/AbCdEfGh1234567 or example1234567890ABCdefg",
    ]
    docs = documents(spark, texts)
    out = secrets.scan(docs)
    assert out.columns == [*docs.columns, "_spans"]
    spans = F.col("_spans")
    listed = {r[0]: r[1] for r in out.select("doc_id", secrets.listed(spans, secrets.KINDS)).collect()}
    assert listed[0] == listed[1] == "" and listed[7] == ""
    assert listed[2] == "assign:3:23"
    assert listed[3] == f"access:0:{len(key)}"
    assert listed[4].startswith("hex:0:24")
    assert listed[5] == f"entropy_mixed:4:{4 + len(mixed)}"
    assert listed[6] == f"assign:0:{7 + len(mixed)}"


# --- top-k -----------------------------------------------------------------------------------------


def brute_top(vectors, k):
    whole = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        scaled = [int(np.floor(64 * x)) for x in v]
        whole[i] = min(whole.get(i, scaled), scaled)
    out = {}
    for q in whole:
        if q % 20 == 0:
            scores = []
            for i, v in whole.items():
                if i != q:
                    scores.append((-sum(a * b for a, b in zip(whole[q], v)), i))
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("kind", ["spread", "equal", "skewed"])
def test_top_k_matches_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BUCKET", 37)
    monkeypatch.setattr(topk, "BLOCK", 5)
    rng = np.random.default_rng(2)
    values = rng.normal(size=(260, 8)) * (rng.pareto(1.0, size=(260, 1)) if kind == "skewed" else 1)
    if kind == "equal":
        values = np.round(values[rng.integers(0, 12, 260)], 1)
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    rows += [(None, [1.0]), (400, None), (401, [None, 1.0]), (402, [float("nan")]), (403, [float("inf")]), (420, []), (440, [1e9, -1e12]), (441, [2e12, 3e12])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.search(table, F.col("vec_id") % 20 == 0, k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], max(-topk._LONG, min(topk._LONG, r["score"]))))
    want = {q: [(i, max(-topk._LONG, min(topk._LONG, s))) for i, s in v] for q, v in brute_top(rows, 6).items()}
    assert got == want


def test_top_k_empty_and_repeated(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, block long")
    assert topk.search(table, F.col("vec_id") % 20 == 0).count() == 0
    twice = spark.createDataFrame([(0, [1.0], 1), (0, [1.0], 1), (3, [2.0], 1)], "vec_id long, embedding array<double>, bounds int")
    assert [tuple(r) for r in topk.search(twice, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 3, 64 * 128)]


# --- Jaccard join ----------------------------------------------------------------------------------


def brute_components(texts, width, least):
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(texts)))
    changed = True
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) and sets[j]
    ]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return [(len(s), c) for s, c in zip(sets, label)]


def near_copies(rng, n, base_words, changes):
    base = [f"v{k}" for k in rng.integers(0, 500, base_words)]
    for _ in range(n):
        words = list(base)
        for at in rng.integers(0, base_words, rng.integers(0, changes + 1)):
            words[at] = f"u{rng.integers(0, 10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize(("width", "least", "block"), [(4, 85, 1024), (5, 80, 6)])
def test_jaccard_matches_brute_force(spark, monkeypatch, width, least, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(9)
    texts = [None, "", " ", "one", "One", "one two", "one two three four five six seven"]
    for words, changes in ((12, 1), (40, 2), (90, 6), (150, 12)):
        texts += list(near_copies(rng, 14, words, changes))
    texts += [texts[20]] * 3
    got = {r["doc_id"]: (r["size"], r["component_id"]) for r in jaccard.join(documents(spark, texts), width, least).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, width, least)


@pytest.mark.parametrize("left", [0, 10**6])
def test_jaccard_screened_blocks_match_brute_force(spark, monkeypatch, left):
    for name, value in (("BLOCK", 9), ("FEW", 2), ("ROUNDS", 0), ("LEFT", left), ("CELLS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(31)
    texts = [t for words, changes in ((40, 6), (130, 14)) for t in near_copies(rng, 40, words, changes)]
    got = {r["doc_id"]: (r["size"], r["component_id"]) for r in jaccard.join(documents(spark, texts), 5, 80).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 5, 80)


def test_jaccard_whole_sets_go_only_to_blocks_that_sketches_leave(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    shipped, whole = [], jaccard._sets
    monkeypatch.setattr(jaccard, "_sets", lambda docs, width: shipped.append(docs.count()) or whole(docs, width))
    # many buckets hold all texts of one length, which share a passage without linking
    passage = " ".join(f"p{k}" for k in range(280))
    texts = [f"{passage} " + " ".join(f"q{k}-{j}" for j in range(80)) for k in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(documents(spark, texts), 5, 80).collect()}
    assert got == {k: k for k in range(60)} and not shipped


@pytest.mark.parametrize("rounds", [0, 2])
def test_jaccard_large_buckets_match_brute_force(spark, monkeypatch, rounds):
    for name, value in (("BLOCK", 9), ("FEW", 2), ("PARTNERS", 1), ("ROUNDS", rounds)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(29)
    texts = [t for words, changes in ((40, 6), (130, 14)) for t in near_copies(rng, 60, words, changes)]
    # a passage that texts of one length share without linking
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [f"{passage} " + " ".join(f"q{k}-{j}" for j in range(70)) for k in range(20)]
    got = {r["doc_id"]: (r["size"], r["component_id"]) for r in jaccard.join(documents(spark, texts), 5, 80).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 5, 80)


def test_jaccard_block_returns_no_more_links_than_labels():
    rng = np.random.default_rng(6)
    for least, changes in ((85, 3), (80, 12), (80, 40)):
        texts = [t for words in (60, 150) for t in near_copies(rng, 40, words, changes)]
        sets = [s for s in {s.tobytes(): s for s in jaccard.shingles([t.encode() for t in texts], 4)}.values()]
        n = len(sets)
        names, side = np.arange(100, 100 + n), np.zeros(n, np.int64)
        linked = {(i, j) for i in range(n) for j in range(i) if jaccard.linked(sets[i], sets[j], least)}
        for labels in (names, names % 7):
            for side in (np.zeros(n, np.int64), np.arange(n) % 2):
                pairs = [(i, j) for i, j in linked if len(set(side)) == 1 or side[i] != side[j]]
                found = jaccard.spanning(names, labels, sets, side, least)
                assert len(found) < len(set(labels.tolist()))
                assert {(b - 100, a - 100) for a, b in found} <= set(pairs)
                assert parts(labels, found, names) == parts(labels, [(i + 100, j + 100) for i, j in pairs], names)


def parts(labels, links, names):
    """The label of each member after ``links``, by repeated passes."""
    out, at = np.unique(labels, return_inverse=True)[1], {int(c): k for k, c in enumerate(names)}
    for a, b in links * 2:
        x, y = out[at[a]], out[at[b]]
        out[out == max(x, y)] = min(x, y)
    return out.tolist()


def test_jaccard_signatures_share_one(spark):
    rng = np.random.default_rng(1)
    for size in (6, 7, 13, 40, 200, 900):
        for pieces, differ in ((2, 1), (3, 1), (4, 2)):
            base = rng.integers(0, 2**63, 2 * size).astype(np.uint64)
            for extra in range(size):
                # as different as the limit allows: some elements exchanged, some added
                a, b = base[:size], np.concatenate([base[extra // 2 : size], base[size : size + (extra + 1) // 2]])
                a, b = np.unique(a), np.unique(b)
                if jaccard.linked(a, b, 85) and len(np.setxor1d(a, b)):
                    x, y = jaccard.signatures([a, b], 85, pieces, differ)
                    assert np.intersect1d(x, y).size


def test_jaccard_keeps_one(spark):
    docs = documents(spark, ["a b c d e f g", "a b c d e f g", None, "", "x y", "x y"], ids=[5, 3, 1, None, None, 9])
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "9", "None"]
    assert jaccard.join(nothing(spark)).count() == 0


def test_jaccard_keeps_one_of_signatures_that_the_same_classes_have(spark):
    first = spark.createDataFrame([(1, [10, 11, 12, 20]), (2, [10, 11, 12, 13]), (3, [13, 21])], "class long, signatures array<long>")
    found = sorted(tuple(r) for r in jaccard.members(first).select("signature", "class", "n", "times").collect())
    assert found == [(10, 1, 2, 3), (10, 2, 2, 3), (13, 2, 2, 1), (13, 3, 2, 1)]


def test_jaccard_keep_first_shuffles_no_text_to_drop_a_few(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = documents(spark, [text, text, "other words stand here now"])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = jaccard.keep_first(docs)
        plan = kept._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_jaccard_keeps_one_of_repeated_rows_and_null_ids(spark):
    near = list(near_copies(np.random.default_rng(3), 4, 60, 1))
    docs = documents(spark, [*near, near[0], "a b", "a b", "a b", *["c d"] * 5, "", ""], ids=[None] * 4 + [None, 4, 4, 2, *[7] * 5, 8, 8])
    docs = docs.select("*", *[F.lit(0).alias(c) for c in ("number", "hash", "of", "class", "label", "_id", "_hash")])
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "7", "8", "8", "None"]


# --- language model --------------------------------------------------------------------------------


def test_language_model_counts_and_edges(spark):
    texts = [*TEXTS, *[" ".join(f"w{k % 7}" for k in range(n)) for n in range(60)]]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in language_model.score(docs, head=3).collect()}
    words = {i: [w for w in re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()] + [None] for i, t in enumerate(texts)}
    counts = {}
    for i, ws in words.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = got[i]
        base = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
    assert language_model.score(nothing(spark)).count() == 0
    twice = language_model.score(documents(spark, ["a b"] * 3, ids=[1, 1, None])).collect()
    assert len(twice) == 3 and twice[0]["train_tokens"] == twice[1]["train_tokens"]


@pytest.mark.parametrize("i", [0, 1, 3, None])
def test_language_model_reads_every_training_document(spark, i):
    docs = documents(spark, ["a b a b c"], ids=[i])
    known = language_model.vocabulary(language_model.word_counts(docs), 1)
    unread = GatedModel(known.symbol_counts).flat()
    assert not np.array_equal(language_model.fit(docs, known).flat(), unread)


def test_language_model_spreads_null_ids_over_rounds(spark):
    docs = documents(spark, [f"text {k}" for k in range(60)], ids=[None] * 60)
    turns = docs.groupBy(F.pmod(language_model.turn_key(), F.lit(language_model.ROUNDS))).count().collect()
    assert len(turns) == language_model.ROUNDS


# --- quality classifier ----------------------------------------------------------------------------


def test_factorisation_machine_identity():
    x = quality.features([b"a b a c", b"", b"Q! Q! Q!\nQ!"], [7, None, 3])
    model = quality.FactorisationMachine()
    model.weights[:] = np.random.default_rng(0).normal(size=len(model.weights))
    for r, margin in enumerate(model.margins(x)):
        at = x.row == r
        f, v = x.feature[at], x.value[at]
        pairs = sum(
            model.vectors[:, f[i]] @ model.vectors[:, f[j]] * v[i] * v[j] for i in range(len(f)) for j in range(i)
        )
        assert margin == pytest.approx(model.weights[f] @ v + pairs)


def test_quality_edges(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels, ~quality.held_out())
    scored = quality.score(docs, model)
    assert scored.columns == [*docs.columns, "_score"]
    assert scored.filter("_score < 0 or _score > 1 or _score is null").count() == 0
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    assert quality.keep(nothing(spark), labels).count() == 0


def test_quality_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels, ~quality.held_out())
    rows = quality.score(docs, model).join(labels, "doc_id").filter(quality.held_out("doc_id")).select("quality", "_score").collect()
    right = np.mean([(r["_score"] >= 0.5) == (r["quality"] == 1) for r in rows])
    good = np.mean([r["_score"] >= 0.5 for r in rows if r["quality"] == 1])
    assert right > 0.97 and good > 0.98


# --- the pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        given, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert docs.columns == columns and docs.exceptAll(given).count() == 0
        if k == 3:
            assert docs.columns == columns and docs.join(given, "doc_id", "left_anti").count() == 0
    assert docs.count() == given.count() <= 3 * before
    rows = sorted((r["start"], r["n_tokens"]) for r in docs.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))


def test_ids_digest_is_lowercase_hex():
    assert re.fullmatch("[0-9a-f]{64}", hashlib.sha256(b"").hexdigest())
