"""Benchmark decontamination with suffix arrays over the training text.

Words are runs of bytes other than ASCII ones outside 0-9 and a-z, after A-Z are lowered. A *window*
is 13 consecutive words of a benchmark item, or all words of a shorter one. Training text is handled
in shards, the slices of each scan task: a shard's word sequence gets a suffix array, every benchmark
suffix that starts a window is searched in it by bisection, and runs of neighbouring matches are
joined to the longest verbatim matches with their places.

The suffix array is sparse. A suffix can only match a window if each of its first neighbouring pairs
of words also stands in the benchmark, so other suffixes are left out before sorting; nothing that
matches is lost. Suffixes are compared over the window length, longer matches come from joining.

No shuffle is needed: a document's result is found where the document is read. The benchmark is a
query set of its own; it is sent to the tasks in blocks of a bounded number of bytes, one pass for each.

Null and empty texts have no words and are never contaminated. Repeated documents, null ids and other
columns of ``docs`` are passed on as they are. Items that share a text count each; an item without an
id makes hits but cannot be named. An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import row_of, slices
from statloom.session import cut_lineage

WINDOW = 13
#: A document is contaminated if at least one in this many of its words is hit.
SHARE = 20
#: Benchmark text sent to the tasks at a time.
BLOCK_BYTES = 16 << 20
#: ASCII letters lowered, every other ASCII byte except digits to a blank.
CLEAN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

_FOUND = "_match"
_FOUND_TYPE = "struct<n_words:long,matches:array<struct<start:int,words:int,item:string,at:int>>>"
_MATCH = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("item", pa.string()), ("at", pa.int32())])


class Benchmark:
    """The windows of one block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        words = [(None if i is None else str(i), t.encode().translate(CLEAN).split()) for i, t in items if t]
        self.word: dict[bytes, int] = {}
        sequences = [(i, [self.word.setdefault(x, len(self.word) + 1) for x in w]) for i, w in words if w]
        #: for each window length: places (item, offset) of every different window, and the windows
        self.by_length: dict[int, tuple[np.ndarray, list[list[tuple[str | None, int]]], np.ndarray]] = {}
        places: dict[int, dict[tuple, list]] = {}
        for item, seq in sequences:
            n = min(window, len(seq))
            for at in range(len(seq) - n + 1):
                places.setdefault(n, {}).setdefault(tuple(seq[at : at + n]), []).append((item, at))
        for n, found in places.items():
            windows = np.array(list(found), dtype=np.int64)
            pairs = np.unique(_pairs(windows[:, :-1], windows[:, 1:])) if n > 1 else np.unique(windows)
            self.by_length[n] = (windows, list(found.values()), pairs)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left << 32) | right


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def search(sequence: np.ndarray, benchmark: Benchmark) -> list[tuple[int, int, str | None, int]]:
    """(place, words, item, place in item) of each longest match in a shard's word numbers.

    0 stands for a word that the benchmark does not have; one stands between documents.
    """
    out = []
    for n, (windows, places, pairs) in benchmark.by_length.items():
        if len(sequence) < n:
            continue
        if n == 1:
            starts = np.flatnonzero(_member(sequence, pairs))
        else:
            both = np.flatnonzero((sequence[:-1] > 0) & (sequence[1:] > 0))
            good = np.zeros(len(sequence), dtype=np.int32)
            good[both[_member(_pairs(sequence[both], sequence[both + 1]), pairs)]] = 1
            total = np.concatenate([[0], np.cumsum(good)])
            starts = np.flatnonzero(total[n - 1 : len(sequence)] - total[: len(sequence) - n + 1] == n - 1)
        if not len(starts):
            continue
        suffixes = _keys(sequence[starts[:, None] + np.arange(n)])
        order = np.argsort(suffixes, kind="stable")
        suffix_array, suffixes = starts[order], suffixes[order]
        queries = _keys(windows)
        low, high = np.searchsorted(suffixes, queries, "left"), np.searchsorted(suffixes, queries, "right")
        # each hit by item and diagonal: neighbours on a diagonal are one longer match
        hits = sorted(
            ((item is None, item or "", at - int(p), int(p), at)
            for k in np.flatnonzero(low < high)
            for p in suffix_array[low[k] : high[k]]
            for item, at in places[k])
        )
        run: list = []
        for no_id, item, diagonal, p, at in hits:
            if run and run[:3] == [no_id, item, diagonal] and p == run[3] + run[5] - n + 1:
                run[5] += 1
                continue
            if run:
                out.append((run[3], run[5], None if run[0] else run[1], run[4]))
            run = [no_id, item, diagonal, p, at, n]
        if run:
            out.append((run[3], run[5], None if run[0] else run[1], run[4]))
    return out


def _pass(docs: DataFrame, benchmark: Benchmark, first: bool) -> DataFrame:
    """Add the matches with one block of the benchmark to ``_match``."""
    shipped = docs.sparkSession.sparkContext.broadcast(benchmark)  # BLOCK_BYTES of text at most
    schema = docs.schema if not first else docs.withColumn(_FOUND, F.lit(None).cast(_FOUND_TYPE)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = shipped.value.word.get, shipped.value
        for batch in slices(batches, "text"):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            split = [(t or b"").translate(CLEAN).split() for t in raw]
            sizes = np.array([len(w) for w in split], dtype=np.int64)
            ends = np.cumsum(sizes + 1)
            sequence = np.fromiter((n for w in split for n in (*[known(x, 0) for x in w], 0)), np.int64, int(ends[-1]))
            matches: list[list] = [[] for _ in split]
            for place, words, item, at in search(sequence, block):
                d = int(np.searchsorted(ends, place, "right"))
                start = place - int(ends[d] - sizes[d] - 1)
                matches[d].append({"start": start, "words": words, "item": item, "at": at})
            columns = {c: batch.column(c) for c in batch.schema.names if c != _FOUND}
            if not first:
                for d, before in enumerate(batch.column(_FOUND).field("matches").to_pylist()):
                    matches[d] = before + matches[d]
            columns[_FOUND] = pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(matches, pa.list_(_MATCH))], ["n_words", "matches"]
            )
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column ``_match``: the number of words, and every longest verbatim match.

    A match has its first word and number of words in the document, the item and the first word there.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size) // block_bytes + 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    out = docs
    for k in range(blocks):
        rows = items.filter(block == k).collect()  # about block_bytes of text
        out = _pass(out, Benchmark([(r["item"], r["text"]) for r in rows], window), first=k == 0)
        if k % 8 == 7:
            out = cut_lineage(out)
    return out


def _hit(found) -> F.Column:
    """Words covered by at least one match: the length of the union of their intervals."""
    spans = F.array_sort(F.transform(found, lambda m: F.struct(m["start"].alias("s"), (m["start"] + m["words"]).alias("e"))))
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans,
        state,
        lambda a, m: F.struct(
            F.greatest(a["end"], m["e"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), m["e"] - F.greatest(a["end"], m["s"]))).cast("long").alias("n"),
        ),
        lambda a: a["n"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, **sizes) -> DataFrame:
    """``docs`` with ``_match`` and ``_contamination``: n_words, n_hit, item_ids (sorted), contaminated."""
    out = matches(docs, benchmark, window, **sizes)
    found, n = F.col(f"{_FOUND}.matches"), F.col(f"{_FOUND}.n_words")
    named = F.array_compact(F.transform(found, lambda m: m["item"]))
    n_hit = _hit(found)
    return out.withColumn(
        "_contamination",
        F.struct(
            n.alias("n_words"),
            n_hit.alias("n_hit"),
            F.array_sort(F.array_distinct(named)).alias("item_ids"),
            ((n_hit > 0) & (F.lit(share) * n_hit >= n)).alias("contaminated"),
        ),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents of ``docs`` that are not contaminated, with the same columns."""
    # the caller's columns wait in a struct, where their names cannot clash
    others = [c for c in docs.columns if c != "text"]
    judged = contamination(docs.select("text", row_of(docs, others or ["text"])), benchmark, window, share)
    kept = judged.filter(~F.col("_contamination.contaminated"))
    return kept.select(*[F.col("row").getField(c).alias(c) if c in others else F.col("text") for c in docs.columns])
