"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines of a document are hashed. A window that occurs more than once anywhere
keeps its first occurrence (smallest id, then smallest place); the lines that any later occurrence
covers are removed, overlapping occurrences being merged first. So a passage of three or more lines
stays once in the corpus, and single lines or pairs that recur are left alone.

Windows are counted with partial sums before the shuffle, and the first place of each repeated window
is joined back, so a window that a third of all documents share is never gathered in one task. Two
64-bit hashes identify a window.

Lines end with a line feed. Windows of blank lines only are ignored. Null text stays null and has no
lines; documents of one or two lines are unchanged. Rows with the same id and text are treated alike;
rows with the same id and different texts are different documents. Nulls in the id sort first. Other
columns are kept. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``doc_hash``, ``place`` and two hashes of every window."""
    split = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), _lines("text").alias("lines"))
    starts = F.slice("lines", 1, F.greatest(F.size("lines") - (LINES - 1), F.lit(0)))

    def window(line: Column, i: Column) -> Column:
        parts = [line, *[F.get("lines", i + k) for k in range(1, LINES)]]
        blank = F.trim(F.concat(*parts)) == ""
        return F.struct(blank.alias("blank"), F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(LINES), *parts).alias("b"))

    rows = split.select("doc_id", "doc_hash", F.posexplode(F.transform(starts, window)).alias("place", "w"))
    return rows.filter(~F.col("w.blank")).select("doc_id", "doc_hash", "place", "w.a", "w.b")


def covered(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``doc_hash``, ``places``: where later occurrences of repeated windows begin, ascending."""
    rows = windows(docs)
    here = F.struct("doc_id", "doc_hash", "place")
    repeated = rows.groupBy("a", "b").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    repeated = repeated.filter(F.col("first") != F.col("last")).drop("last")
    later = rows.join(repeated, ["a", "b"]).filter(here != F.col("first"))
    # at most one entry per line of a document
    return later.groupBy("doc_id", "doc_hash").agg(F.sort_array(F.collect_set("place")).alias("places"))


def _gaps(places: Column, n: Column) -> Column:
    """What the merged windows leave: (lines before, lines) of each stretch that stays."""
    stretch = "array<struct<before:int,lines:int>>"
    first = F.struct(F.lit(0).alias("end"), F.array().cast(stretch).alias("kept"))

    def gap(start: Column, end: Column) -> Column:
        return F.array(F.struct(start.alias("before"), (end - start).alias("lines")))

    def step(a: Column, p: Column) -> Column:
        kept = F.when(p > a["end"], F.concat(a["kept"], gap(a["end"], p))).otherwise(a["kept"])
        return F.struct(F.greatest(a["end"], p + LINES).alias("end"), kept.alias("kept"))

    return F.aggregate(places, first, step, lambda a: F.concat(a["kept"], gap(a["end"], n)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` without later occurrences, and ``_lines``: (before, removed)."""
    found = covered(docs).select(
        F.col("doc_id").alias("_of_id"), F.col("doc_hash").alias("_of_hash"), F.col("places").alias("_places")
    )
    same = docs["doc_id"].eqNullSafe(F.col("_of_id")) & (F.xxhash64(docs["text"]) == F.col("_of_hash"))
    out = docs.join(found, same, "left")
    n = F.coalesce(F.size(F.when(F.col("text").isNotNull(), _lines("text"))), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n)
    gaps = _gaps(F.col("_places"), F.size(_lines("text")))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(_lines("text"), g["before"] + 1, g["lines"])))
    text = F.when(F.col("_places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("_places").isNull(), 0).otherwise(
        F.size(_lines("text")) - F.aggregate(gaps, F.lit(0), lambda s, g: s + g["lines"])
    )
    counts = F.struct(n.cast("long").alias("before"), removed.cast("long").alias("removed"))
    out = out.withColumns({"_lines": counts, "_kept_text": text})
    return out.select(*[F.col("_kept_text").alias(c) if c == "text" else docs[c] for c in docs.columns], "_lines")
