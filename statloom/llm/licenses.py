"""License scan as an exact set-similarity join of text blocks with license templates.

Words are runs of characters other than the ASCII ones outside 0-9 and a-z, after A-Z are lowered. A block
is 64 consecutive words, a new one begins every 32, so every passage of up to 33 words lies whole in a
block. A template is the set of words of a license notice; a block meets it if it holds at least the share
``least`` of the template's words. A phrase is a template whose words must all be there, and stand in line.

Only words of templates can be shared, so the global order ranks those: by the number of documents they
occur in, rarest first. A template of s words of which n must be shared cannot meet a block that holds none
of its s - n + 1 rarest ones, its *prefix*. Blocks with no word of any prefix are dropped while the text is
read; the others become rows and join the templates on their prefix words. A joined pair goes on only if
the block holds enough ranked words (length filter) and enough of them follow on both sides from the shared
word on (positional filter); then the shared words are counted, and a phrase's places are looked up.

Nothing is shuffled but the word counts (one row a task and template word), the blocks' matches and the
rows of the result: the templates are a table of the caller's, whose words are counted on the driver.

Null and empty texts have no words and no spans. A document's blocks are cut from its whole text, however
long. Repeated rows and null ids each give a row of their own. Documents keep their columns in the struct
``row``, so that no name can clash. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import row_of
from statloom.session import cut_lineage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 64
STRIDE = 32
#: Share of a template's words that a block must hold.
LEAST = 0.8
#: Phrases that count where their words stand consecutively (fixed values), and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices of licenses and their labels; a notice may come without its exact wording or order.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
}

SPAN = "array<struct<start: int, stop: int, label: string, phrase: boolean, share: double>>"


def words_of(text: str = "text") -> Column:
    """The words of a text; only ASCII letters matter in lower case, as templates are ASCII.

    The Kelvin sign is the one character that another case folding would turn into an ASCII letter.
    """
    t = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("K"), F.lit("ĸ"))
    return F.array_remove(F.split(F.lower(t), SEPARATORS), "")


def _words(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.lit([]).cast("array<string>")


def ranked_words(docs: DataFrame, patterns: Sequence[str], text: str = "text") -> list[str]:
    """The words of the patterns by the number of documents that hold them, rarest first."""
    vocabulary = sorted({w for p in patterns for w in p.split()})
    held = docs.select(F.explode(F.array_intersect(_words(vocabulary), words_of(text))).alias("word"))
    found = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def _templates(phrases: Mapping[str, str], templates: Mapping[str, str], least: float, ranked: Sequence[str]) -> list[tuple]:
    """(label, words in line or None, words by rank, number of words, number that must be shared)."""
    rank = {w: k for k, w in enumerate(ranked)}
    out = []
    for listed, line in ((phrases, True), (templates, False)):
        for pattern, label in listed.items():
            words = sorted(set(pattern.split()), key=rank.__getitem__)
            need = len(words) if line else math.ceil(round(least * len(words), 9))
            out.append((label, pattern.split() if line else None, words, len(words), need))
    return out


def scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    least: float = LEAST,
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """row, n_words, spans: every document, with the columns ``keep`` (all) in ``row``.

    A span is a phrase's place (its first word's number, the one after its last, share 1) or a block
    that meets a template, with the share of the template's words that it holds. Spans come in order.
    """
    longest = max((len(p.split()) for p in phrases), default=1)
    if longest > BLOCK - STRIDE + 1 or any(not p.split() for p in (*phrases, *templates)):
        raise ValueError(f"phrases have 1 to {BLOCK - STRIDE + 1} words, templates at least one")
    ranked = ranked_words(docs, [*phrases, *templates], text)
    found = _templates(phrases, templates, least, ranked)
    prefixes = {w for _, _, words, size, need in found for w in words[: size - need + 1]}
    prefix_words = [w for w in ranked if w in prefixes]

    # while the text is read: blocks with a word of any prefix
    read = docs.select(row_of(docs, keep), words_of(text).alias("words"))
    n_words = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n_words - 1, F.lit(0)), F.lit(STRIDE))
    blocks = F.transform(
        starts, lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, F.lit(BLOCK)).alias("words"))
    )
    near = F.when(
        F.arrays_overlap("words", _words(prefix_words)),
        F.filter(blocks, lambda b: F.arrays_overlap(b["words"], _words(prefix_words))),
    )
    kept = read.select("row", n_words.cast("long").alias("n_words"), near.alias("blocks"))
    kept = cut_lineage(kept.withColumn("place", F.monotonically_increasing_id()))

    # the join on prefix words
    listed = [
        (label, line, words, size, need, i, words[i])
        for label, line, words, size, need in found
        for i in range(size - need + 1)
    ]
    schema = "label string, line array<string>, template array<string>, size int, need int, i int, word string"
    prefix_table = docs.sparkSession.createDataFrame(listed, schema)
    block = kept.select("place", F.inline("blocks"))
    block = block.withColumn("held", F.array_intersect(_words(ranked), F.col("words")))
    block = block.select("*", F.posexplode("held").alias("j", "word")).where(F.col("word").isin(prefix_words))
    left = F.least(F.col("size") - F.col("i"), F.size("held") - F.col("j"))
    pairs = block.join(prefix_table, "word").where((F.size("held") >= F.col("need")) & (left >= F.col("need")))
    pairs = pairs.withColumn("shared", F.array_intersect("template", "held"))
    # of the prefix words that a pair shares, the rarest one stands for the pair
    pairs = pairs.where((F.size("shared") >= F.col("need")) & (F.col("shared")[0] == F.col("word")))

    # places of phrases, each in the block in whose first half it begins; whole blocks otherwise
    last = F.least(F.lit(STRIDE - 1), F.size("words") - F.size("line"))
    offsets = F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda o: F.slice("words", o + 1, F.size("line")) == F.col("line")))
    matched = pairs.select(
        "place",
        F.explode(F.when(F.col("line").isNull(), F.array(F.lit(0))).otherwise(offsets)).alias("offset"),
        F.size(F.coalesce("line", "words")).alias("long"),
        "start",
        "label",
        F.col("line").isNotNull().alias("phrase"),
        (F.size("shared") / F.col("size")).alias("share"),
    )
    start = F.col("start") + F.col("offset")
    span = F.struct(start.alias("start"), (start + F.col("long")).alias("stop"), "label", "phrase", "share")
    by_document = matched.groupBy("place").agg(F.array_sort(F.collect_list(span)).cast(SPAN).alias("spans"))
    out = kept.select("row", "n_words", "place").join(by_document, "place", "left")
    return out.select("row", "n_words", F.coalesce("spans", F.lit([]).cast(SPAN)).alias("spans"))


def labels(spans: Column) -> Column:
    """The distinct labels of spans, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
