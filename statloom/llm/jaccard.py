"""N-gram Jaccard join with PartEnum signatures.

A document's set is its distinct word shingles, each a 64-bit hash. Two sets link when their Jaccard
similarity is ``least`` percent or more. Then their sizes are alike and their symmetric difference
is at most a bound k. Sizes are cut into bands whose ends have the least ratio; a set belongs to its
own band and the next, so similar sets share one. In each band the feature domain is cut into n1
parts, and each part into n2 pieces. With n1 * (k2 + 1) > k, similar sets differ in at most k2
elements of some part, so they agree in n2 - k2 of its pieces: every such subset of pieces gives one
signature, and similar sets share at least one. No link is lost.

There are ``SPARE`` times as many parts as that takes, so similar sets share at least m signatures, and
each set drops its m - 1 with the fewest elements: of equal signatures both sets drop the same ones last.
So empty pieces, which any two sets may share, hardly ever make a signature.

Sets that are equal form a *class*, known by a digest. From then on there is one row per class:

1. Signatures are dealt by ranges and read in order; those of a single class are dropped.
2. Each class that is left gets a *sketch*: its elements added up in cells. Sets that differ in more
   cells than k cannot link, so sketches rule pairs out before any text is compared.
3. In each bucket of several labels (connected components of the links found so far) a member meets one end
   of the bucket, the smallest or largest of another label; of these it is paired with the one met most often.
   Pairs that the sketches leave are verified exactly on the whole texts. ``ROUNDS`` times, which joins most
   groups of near copies with one pair a member.
4. Small buckets that still hold several labels give all their pairs across labels, at most ``FEW - 1`` for a member.
5. Large buckets that hold several labels are compared once, in blocks of bounded size that hold sketches. A block
   gives the pairs across its labels that the sketches leave, and these are verified like the others. Where they are
   more than ``LEFT`` times its members, the members of these pairs meet again in a block that holds their whole sets, compares all
   pairs across labels exactly and returns just enough links to tie the labels that it links.

So a group of near copies never gives a row for each of its pairs, and no pair that could join two
components stays untested. Components come from repeated joins with cut lineage. Only counts reach
the driver.

Null and empty texts have no set, size 0, and link with nothing. A text of fewer words than a shingle
has one. Repeated rows fall into one class. A null id takes part; the smallest other id names the
component, and null if there is none. Other columns are ignored. Hashes have 64 bits, signatures 48.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import fresh, lowered, slices, texts
from statloom.session import cut_lineage

#: Pieces of a part, and how many of them may differ.
PIECES, DIFFER = 2, 1
#: Parts of the feature domain, as a multiple of the least number that loses no link.
SPARE = 1.3
#: How often members meet the ends of their buckets before buckets are compared member by member.
ROUNDS = 2
#: Members of a bucket in one chunk, and elements of their sets; two chunks are compared in one block.
BLOCK, ELEMENTS = 1024, 1 << 21
#: Members of a bucket up to which all its pairs are listed.
FEW = 16
#: Pairs a member that a block of sketches may give, and bytes of sketches compared at a time.
LEFT, CELLS = 4, 1 << 23
#: Members that a block compares with all its others at a time, and different elements counted at a time.
PARTNERS, COLUMNS = 256, 2048
#: Repeated signatures, or documents, up to which a join is told to send them to all tasks.
SMALL = 3_000_000
#: Words a Python worker remembers with their hash.
REMEMBERED = 300_000

#: The bits of a signature that are kept; a false match meets the sketches, so no more are worth their disk.
KEPT = np.uint64((1 << 48) - 1)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64 over all others."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


WORDS = Words()


def shingles(documents: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    get, out = WORDS.__getitem__, []
    for d in documents:
        words = lowered(d).split()
        h = mix(np.fromiter(map(get, words), np.uint64, len(words)))
        if not len(h):
            out.append(h)
            continue
        n = max(len(h) - width + 1, 1)
        value = np.full(n, len(h) if len(h) < width else width, dtype=np.uint64)
        for k in range(min(width, len(h))):
            value = mix(value + h[k : k + n] * ODD[k % 4] + np.uint64(k))
        out.append(np.unique(value))
    return out


@cache
def bands(least: int, up_to: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest size and largest symmetric difference of each band, until ``up_to`` is covered twice."""
    ends = [0]
    while len(ends) < 3 or ends[-2] < up_to:
        ends.append((ends[-1] + 1) * 100 // least)
    ends = np.array(ends, dtype=np.int64)
    return ends, (100 - least) * 2 * ends // (100 + least)


def digest(values: np.ndarray) -> int:
    """An order-free 64-bit digest of a set, as a signed number."""
    total = mix(values + np.uint64(1)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total * ODD[:1] + np.uint64(len(values))).view(np.int64)[0])


def signatures(sets: list[np.ndarray], least: int, pieces: int = PIECES, differ: int = DIFFER) -> list[np.ndarray]:
    """PartEnum signatures of each set; none where only equal sets can link.

    Linked sets agree in at least ``shared`` of the ``total`` signatures of a band, so the first
    total - shared + 1 in one common order hold an equal one. The order is by elements, most first.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ends, bounds = bands(least, 1 << max(int(sizes.max(initial=1)), 1).bit_length())
    own = np.searchsorted(ends, sizes)
    values = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
    low, high = (values & np.uint64(0xFFFFFFFF)).astype(float), (values >> np.uint64(32)).astype(float)
    out: list[list[np.ndarray]] = [[] for _ in sets]
    for up in (0, 1):
        band = own + up
        most = bounds[band]
        parts = np.where((sizes > 0) & (most > 0), (most * SPARE).astype(np.int64) // (differ + 1) + 1, 0)
        cells = parts * pieces
        total = parts * comb(pieces, differ)
        shared = cells - most if pieces - differ == 1 else parts - most // (differ + 1)
        taken = np.where(parts > 0, total - shared + 1, 0)
        first = np.cumsum(cells) - cells
        which = np.repeat(np.arange(len(sets)), sizes)
        used = cells[which] > 0
        spread = mix(values[used] ^ ODD[1]) >> np.uint64(11)
        at = first[which[used]] + (spread % cells[which[used]].astype(np.uint64)).astype(np.int64)
        n = int(cells.sum())
        # sums of 32-bit halves are exact in float64
        sums = np.bincount(at, low[used], n).astype(np.uint64) + (np.bincount(at, high[used], n).astype(np.uint64) << np.uint64(32))
        sums = sums.reshape(-1, pieces)
        part_of = np.arange(len(sums), dtype=np.uint64) - np.repeat(np.cumsum(parts) - parts, parts).astype(np.uint64)
        salt = np.repeat(band, parts).astype(np.uint64) * ODD[2] + part_of * ODD[3]
        held = np.bincount(at, minlength=n).reshape(-1, pieces)
        chosen, elements = [], []
        for c, subset in enumerate(combinations(range(pieces), pieces - differ)):
            value = salt + np.uint64(c)
            for p in subset:
                value = mix(value + sums[:, p])
            chosen.append(value)
            elements.append(held[:, list(subset)].sum(axis=1))
        table, elements = np.stack(chosen, axis=1).ravel(), np.stack(elements, axis=1).ravel()
        of = np.repeat(np.arange(len(sets)), total)
        order = np.lexsort((-elements, of))  # stable: ties stay in the order of the parts
        place = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total)
        table = table[order[place < taken[of]]]
        starts = np.cumsum(taken) - taken
        for d in np.flatnonzero(taken):
            out[d].append(table[starts[d] : starts[d] + taken[d]])
    return [np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in out]


def sketch(values: np.ndarray) -> np.ndarray:
    """Sums modulo 256 of the elements that fall into each of 2 ** m cells, at most as many as elements (or 32).

    Halving the cells by adding neighbours gives the sketch of the next smaller m.
    """
    m = max(len(values), 32).bit_length() - 1
    h = mix(values ^ ODD[2])
    cell = (h >> np.uint64(64 - m)).astype(np.int64)
    return (np.bincount(cell, (h & np.uint64(0xFF)).astype(float), 1 << m).astype(np.int64) & 0xFF).astype(np.uint8)


def most_different(a: int | np.ndarray, b: int | np.ndarray, least: int) -> int | np.ndarray:
    """The largest symmetric difference of linked sets of sizes a and b."""
    return (100 - least) * (a + b) // (100 + least)


def linked(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= least * (len(a) + len(b) - both)


def _described(docs: DataFrame, width: int, least: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``size``, ``class``, ``sketch`` and ``signatures`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = shingles(texts(batch, "text"), width)
            given = signatures(found, least)
            ends = np.concatenate([[0], np.cumsum([len(g) for g in given])]).astype(np.int32)
            values = (np.concatenate([*given, np.zeros(0, dtype=np.uint64)]) & KEPT).view(np.int64)
            columns = {
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "text_hash": batch.column("text_hash"),
                "size": pa.array([len(s) for s in found], pa.int64()),
                "class": pa.array([digest(s) for s in found], pa.int64()),
                "sketch": pa.array([sketch(s).tobytes() for s in found], pa.binary()),
                "signatures": pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
            }
            yield pa.record_batch(columns)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, size long, class long, sketch binary, signatures array<long>"
    return rows.mapInArrow(run, schema)


def _told_small(df: DataFrame, rows: int) -> DataFrame:
    """Send a side of a join to all tasks if its counted rows are few; else leave the join to Spark."""
    return F.broadcast(df) if rows <= SMALL else df


def _neighbours(signed: DataFrame) -> DataFrame:
    """The rows of ``signature``, ``class`` whose signature other classes have too, and few others, each once.

    The rows are dealt by ranges of both columns, so a frequent signature spreads over tasks, and each range is
    read in order: a row stays if the one before or after it has its signature, or if it stands next to
    the end of its range, where the neighbour is not seen. The shuffle is the only one that all signatures meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        first = True
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("signature", "class")], axis=1)
            rows = np.concatenate([*held, rows])
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            rows = rows[new]
            same = rows[1:, 0] == rows[:-1, 0]
            keep = np.zeros(len(rows), dtype=bool)
            keep[1:] |= same
            keep[:-1] |= same
            if first and len(rows) > 1:
                keep[0], first = True, False
            # the last row is held back, with the one before if they belong together, and read again with the next batch
            held = [rows[-2:] if keep[-1:].any() else rows[-1:]]
            keep[-1:] = False
            yield _signed(rows[keep])
        if held:
            yield _signed(held[0])

    dealt = signed.repartitionByRange("signature", "class").sortWithinPartitions("signature", "class")
    return dealt.mapInArrow(run, "signature long, class long")


def _signed(rows: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"signature": pa.array(rows[:, 0]), "class": pa.array(rows[:, 1])})


def members(first: DataFrame) -> DataFrame:
    """``signature``, ``class``, ``n`` of the signatures that ``n`` > 1 classes have; ``first`` has a row per class.

    Of signatures that the same classes have, one stays: the others hold the same pairs. ``times`` counts them.
    """
    signed = first.select(F.explode("signatures").alias("signature"), "class")
    # rows next to the end of a batch may come twice
    different = cut_lineage(_neighbours(signed)).distinct()
    held = (F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), F.bit_xor(F.xxhash64("class")).alias("all"))
    sizes = different.groupBy("signature").agg(*held).filter("n > 1")
    one = sizes.groupBy("n", "low", "high", "all").agg(F.min("signature").alias("signature"), F.count("*").alias("times"))
    return cut_lineage(different.join(one.select("signature", "n", "times"), "signature"))


def _several(rows: DataFrame, what: str) -> DataFrame:
    """The rows of signatures that have more than one value of ``what``."""
    ends = rows.groupBy("signature").agg(F.min(what).alias("_a"), F.max(what).alias("_b")).filter("_a <> _b")
    return rows.join(ends.select("signature"), "signature", "left_semi")


def _firsts(described: DataFrame) -> DataFrame:
    """``class`` with the id and text hash of its first document."""
    first = described.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("d"))
    return cut_lineage(first.select("class", F.col("d.doc_id").alias("_id"), F.col("d.text_hash").alias("_hash")))


def _without_copies(described: DataFrame, firsts: DataFrame) -> DataFrame:
    """The row of the first document of each class."""
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    copies = described.select("doc_id", "text_hash", "class").join(firsts, "class").filter(~own)
    copies = cut_lineage(copies.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    return described.join(_told_small(copies, copies.count()), own, "left_anti")


def _representatives(docs: DataFrame, firsts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class`` and ``text`` of the first document of the classes in ``wanted``."""
    chosen = cut_lineage(firsts.join(wanted.select("class").distinct(), "class", "left_semi"))
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash"))
    return docs.join(_told_small(chosen, chosen.count()), same).select("class", docs["text"])


def _likely(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """The pairs ``a``, ``b`` that the sketches leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "sketch_a"):
            sizes = np.array([batch.column(c).to_pylist() for c in ("size_a", "size_b")], dtype=np.int64)
            most = most_different(sizes[0], sizes[1], least)
            cells = [[np.frombuffer(x, np.uint8) for x in batch.column(c).to_pylist()] for c in ("sketch_a", "sketch_b")]
            near = [
                100 * min(m, n) >= least * max(m, n) and apart(x, y) <= k
                for m, n, k, x, y in zip(*sizes.tolist(), most.tolist(), *cells)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    of = {k: sketches.select(F.col("class").alias(k), F.col("size").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab"}
    return pairs.join(of["a"], "a").join(of["b"], "b").mapInArrow(run, "a long, b long")


def _labelled(found: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their label, the class itself where it has no link yet."""
    if labels is None:
        return found.withColumn("label", F.col("class"))
    return found.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))


def _met(labelled: DataFrame) -> DataFrame:
    """``a``, ``b``: each member with the end of another label that it meets in most buckets, ties to the smallest."""
    own = F.struct("label", "class")
    ends = labelled.groupBy("signature").agg(F.min(own).alias("low"), F.max(own).alias("high")).filter("low.label <> high.label")
    other = F.when(F.col("label") != F.col("low.label"), F.col("low.class")).otherwise(F.col("high.class"))
    met = labelled.join(ends, "signature").groupBy("class", other.alias("other")).agg(F.sum("times").alias("n"))
    best = met.groupBy("class").agg(F.min(F.struct(-F.col("n"), "other")).alias("best"))
    return best.select(F.least("class", "best.other").alias("a"), F.greatest("class", "best.other").alias("b")).distinct()


def _listed(small: DataFrame, labels: DataFrame) -> DataFrame:
    """``a``, ``b``: the pairs of small buckets across labels."""
    rows = cut_lineage(_several(_labelled(small, labels), "label"))
    left = rows.select("signature", F.col("class").alias("a"), F.col("label").alias("label_a"))
    right = rows.select("signature", F.col("class").alias("b"), F.col("label").alias("label_b"))
    return left.join(right, "signature").filter("a < b AND label_a <> label_b").select("a", "b").distinct()


def _verified(pairs: DataFrame, of: DataFrame, width: int, least: int) -> DataFrame:
    """``a``, ``b`` with ``linked``: the exact comparison of the two whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a"):
            left, right = shingles(texts(batch, "text_a"), width), shingles(texts(batch, "text_b"), width)
            found = [linked(x, y, least) for x, y in zip(left, right)]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(found, pa.bool_())})

    of = of.dropDuplicates(["class"])  # rows that repeat a document
    first = pairs.join(of.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(of.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    return cut_lineage(both.mapInArrow(run, "a long, b long, linked boolean"))


def _forest(edges: DataFrame) -> bool:
    """Whether ``edges`` are stars already: no node has two smaller ones, or both a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("is")).union(edges.select(F.col("b").alias("u"), F.lit(0).alias("is")))
    up = ends.groupBy("u").agg(F.sum("is").alias("up"), F.min("is").alias("least"))
    return up.filter("up > 1 OR up > least").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``class``, ``label`` (the smallest class reachable) for every class in ``links`` (``a``, ``b``).

    Alternating stars: every node's larger neighbours, then its smaller ones, are tied to the smallest,
    until only stars are left.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges = cut_lineage(edges.distinct())
    while not _forest(edges):
        for larger in (True, False):
            both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
            if larger:
                both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
            lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
            tied = both.join(lowest, "u")
            tied = tied.filter("v > u") if larger else tied
            new = tied.select(F.col("v").alias("a"), F.col("low").alias("b"))
            if not larger:
                new = new.union(lowest.select(F.col("u").alias("a"), F.col("low").alias("b")))
            new = new.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            edges = cut_lineage(new.filter("a <> b").distinct())
    whole = edges.select(F.col("a").alias("class"), F.col("b").alias("label"))
    return whole.union(whole.select(F.col("label").alias("class"), "label").distinct())


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The labels after new ``links`` (``a``, ``b``): components of the labels that the links tie, passed on to their classes."""
    if labels is None:
        return cut_lineage(components(links))
    of = {k: labels.select(F.col("class").alias(k), F.col("label").alias(f"label_{k}")) for k in "ab"}
    ties = links.join(of["a"], "a", "left").join(of["b"], "b", "left")
    ties = ties.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    roots = components(ties).select(F.col("class").alias("label"), F.col("label").alias("root"))
    known = labels.join(roots, "label", "left").select("class", F.coalesce("root", "label").alias("label"))
    # classes without a label until now are their own
    new = roots.select(F.col("label").alias("class"), F.col("root").alias("label")).join(labels, "class", "left_anti")
    return cut_lineage(known.unionByName(new))


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """In how many cells two sketches differ, at the smaller number of cells."""
    x, y = _folded([a, b])
    return int(np.count_nonzero(x != y))


def _folded(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches brought to the smallest number of cells among them."""
    size, out = min(len(s) for s in sketches), []
    for s in sketches:
        while len(s) > size:
            s = s[::2] + s[1::2]
        out.append(s)
    return np.stack(out)


def spanning(classes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], side: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links of a block that tie all labels which its links across labels tie, fewer than there are labels.

    A pair is compared exactly unless links found before tie its labels. So members of the label that is the
    largest by then wait: they are compared only with those that come to their turn. ``side`` has the chunk
    of each member: of two chunks, only pairs across them are compared.
    """
    sizes, two = np.array([len(s) for s in sets], dtype=np.int64), len(set(side.tolist())) == 2
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], np.repeat(np.arange(len(sets)), sizes)[order]
    root, met = np.unique(labels, return_inverse=True)[1], np.zeros(len(sets), dtype=bool)
    found: list[tuple[int, int]] = []
    while True:
        some = np.flatnonzero(~met & (root != np.bincount(root).argmax()))[:PARTNERS]
        if not len(some):
            return found
        met[some] = True
        now = np.zeros(len(sets), dtype=bool)
        now[some] = True
        wanted = np.zeros(int(place[-1]) + 1, dtype=bool)
        wanted[place[now[owner]]] = True
        column, owns = (np.cumsum(wanted) - 1)[place[wanted[place]]], owner[wanted[place]]
        both = np.zeros((len(some), len(sets)), dtype=np.int64)
        for first in range(0, int(wanted.sum()), COLUMNS):
            at = slice(*np.searchsorted(column, [first, first + COLUMNS]))
            held = np.zeros((len(sets), COLUMNS), np.float32)
            held[owns[at], column[at] - first] = 1
            both += (held[some] @ held.T).astype(np.int64)
        near = (both > 0) & (100 * both >= least * (sizes[some, None] + sizes - both))
        if two:
            near &= side[some, None] != side
        for x, linked_to in zip(some, near):
            others = np.flatnonzero(linked_to & (root != root[x]))
            for r, k in zip(*np.unique(root[others], return_index=True)):
                pair = int(classes[x]), int(classes[others[k]])
                found.append((min(pair), max(pair)))
                root[root == r] = root[x]


def _placed(open_: DataFrame) -> DataFrame:
    """The members of each block: ``signature``, ``block``, ``side``, ``class``, ``label``.

    A bucket of up to ``BLOCK`` members is a block; a set of more than its share of ``ELEMENTS`` counts as several
    members. In a larger one each label with more than half as many has chunks
    of its own and the other labels share chunks; two chunks make a block unless both are of one label.
    So a large label meets the others in its bucket, but not itself.
    """
    load = F.greatest(F.ceil(F.col("size") * BLOCK / ELEMENTS), F.lit(1))
    counts = open_.groupBy("signature", "label").agg(F.sum(load).alias("n"))
    totals = counts.groupBy("signature").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("n") * 2 <= BLOCK, F.col("n"))).alias("rest"))
    alone = (F.col("total") > BLOCK) & (F.col("n") * 2 > BLOCK)
    shared = F.when(F.col("total") > BLOCK, F.col("rest")).otherwise(BLOCK)
    kinds = counts.join(totals, "signature").select(
        "signature",
        "label",
        F.when(alone, F.col("label")).alias("of"),
        F.ceil(F.when(alone, F.col("n")).otherwise(shared) / BLOCK).alias("chunks"),
    )
    kinds = cut_lineage(kinds)
    chunk = F.struct("of", F.pmod(F.xxhash64("class"), F.col("chunks")).alias("k")).alias("chunk")
    rows = open_.join(kinds, ["signature", "label"]).select("signature", "class", "label", chunk)
    chunks = kinds.select("signature", "of", "chunks").distinct()
    chunks = chunks.select("signature", "of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("k"))
    chunks = chunks.select("signature", F.struct("of", "k").alias("chunk"))
    pairs = chunks.withColumnRenamed("chunk", "p").join(chunks.withColumnRenamed("chunk", "q"), "signature")
    pairs = pairs.filter((F.col("p") <= F.col("q")) & (F.col("p.of").isNull() | ~F.col("p.of").eqNullSafe(F.col("q.of"))))
    block = F.xxhash64("p.of", "p.k", "q.of", "q.k").alias("block")
    left = pairs.select("signature", F.col("p").alias("chunk"), block, F.lit(0).alias("side"))
    right = pairs.filter("p <> q").select("signature", F.col("q").alias("chunk"), block, F.lit(1).alias("side"))
    return rows.join(left.union(right), ["signature", "chunk"]).drop("chunk")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``class`` and ``elements``, the sorted shingles of ``text``, once for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [s.tobytes() for s in shingles(texts(batch, "text"), width)]
            yield pa.record_batch({"class": batch.column("class"), "elements": pa.array(found, pa.binary())})

    return docs.dropDuplicates(["class"]).mapInArrow(run, "class long, elements binary")


def left(labels: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], side: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the pairs of a block across its labels (of two chunks, across them) that sizes and sketches leave."""
    cells, two = _folded(sketches), len(set(side.tolist())) == 2
    near = np.triu(labels[:, None] != labels) & (100 * np.minimum(sizes[:, None], sizes) >= least * np.maximum(sizes[:, None], sizes))
    if two:
        near &= side[:, None] != side
    a, b = np.nonzero(near)
    most, step = most_different(sizes[a], sizes[b], least), max(CELLS // cells.shape[1], 1)
    differ = [(cells[a[k : k + step]] != cells[b[k : k + step]]).sum(axis=1) for k in range(0, len(a), step)]
    keep = np.concatenate([*differ, np.zeros(0, np.int64)]) <= most
    return a[keep], b[keep]


def _screened(placed: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """What the sketches leave of each block: pairs ``a``, ``b``, or where these are many, its members ``a`` that are in one.

    ``signature``, ``block`` and ``side`` tell where a member stood; ``b`` is null then.
    """
    rows = placed.join(sketches, "class").select("signature", "block", "side", "class", "label", "size", "sketch")

    def run(table: pa.Table) -> pa.Table:
        members, labels, sizes, side = (table.column(c).to_numpy() for c in ("class", "label", "size", "side"))
        cells = [np.frombuffer(x, np.uint8) for x in table.column("sketch").to_pylist()]
        a, b = left(labels, sizes, cells, side, least)
        if len(a) > LEFT * len(members):
            at, ends = np.union1d(a, b), None
            starts = members[at]
        else:
            at, starts, ends = a, np.minimum(members[a], members[b]), np.maximum(members[a], members[b])
        of = table.select(["signature", "block", "side"]).take(pa.array(at))
        ends = pa.nulls(len(at), pa.int64()) if ends is None else pa.array(ends)
        return of.append_column("a", pa.array(starts)).append_column("b", ends)

    return rows.groupBy("signature", "block").applyInArrow(run, "signature long, block long, side int, a long, b long")


def _tied(crowded: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """``a``, ``b``: the links that the blocks of ``crowded`` (``signature``, ``block``, ``side``, ``class``, ``label``) return."""
    rows = crowded.join(sets, "class").select("signature", "block", "side", "class", "label", "elements")

    def run(table: pa.Table) -> pa.Table:
        # one block: at most two chunks of a bucket
        held = [np.frombuffer(x, np.uint64) for x in table.column("elements").to_pylist()]
        pairs = spanning(*(table.column(c).to_numpy() for c in ("class", "label")), held, table.column("side").to_numpy(), least)
        a, b = list(zip(*pairs)) or [(), ()]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("signature", "block").applyInArrow(run, "a long, b long")


def classes(docs: DataFrame, width: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Every document with its class, and the label of every class that has links."""
    docs = docs.select("doc_id", "text")
    described = cut_lineage(_described(docs, width, least))
    firsts = _firsts(described)
    first = _without_copies(described, firsts)
    found = members(first)
    sketches = first.select("class", "size", "sketch").join(found.select("class").distinct(), "class", "left_semi")
    sketches = cut_lineage(sketches.dropDuplicates(["class"]))
    verified: DataFrame | None = None
    labels: DataFrame | None = None

    def compare(pairs: DataFrame) -> None:
        """Verify pairs that were not tested before and renew the labels."""
        nonlocal verified, labels
        ends = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class")))
        of = cut_lineage(_representatives(docs, firsts, ends))
        new = _verified(pairs, of, width, least)
        verified = new if verified is None else verified.unionByName(new)
        labels = merged(labels, new.filter("linked"))

    def untested(pairs: DataFrame) -> DataFrame:
        return pairs if verified is None else pairs.join(verified, ["a", "b"], "left_anti")

    for _ in range(ROUNDS):
        met = untested(_met(_labelled(found, labels)))
        compare(cut_lineage(_likely(met, sketches, least)))
    listed = untested(_listed(found.filter(F.col("n") <= FEW), labels))
    compare(cut_lineage(_likely(listed, sketches, least)))
    large = _labelled(found.filter(F.col("n") > FEW).select("signature", "class"), labels)
    open_ = cut_lineage(_several(large, "label").join(sketches.select("class", "size"), "class"))
    if not open_.isEmpty():
        screened = cut_lineage(_screened(_placed(open_), sketches, least))
        compare(cut_lineage(untested(screened.filter("b IS NOT NULL").select("a", "b").distinct())))
        crowded = screened.filter("b IS NULL").select("signature", "block", "side", F.col("a").alias("class"))
        if not crowded.isEmpty():
            sets = cut_lineage(_sets(_representatives(docs, firsts, crowded), width))
            labels = merged(labels, cut_lineage(_tied(_labelled(crowded, labels), sets, least)))
    return described, labels


def join(docs: DataFrame, width: int = 4, least: int = 85) -> DataFrame:
    """``doc_id``, ``text_hash``, ``size`` and ``component_id`` (smallest id reachable) of every document."""
    described, labels = classes(docs, width, least)
    whole = described.select("doc_id", "text_hash", "size", "class").join(labels, "class", "left").withColumn("_part", F.coalesce("label", "class"))
    first = whole.filter("size > 0").groupBy("_part").agg(F.min("doc_id").alias("first"))
    out = whole.join(first, "_part", "left")
    component = F.when(F.col("size") > 0, F.col("first")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "size", component.alias("component_id"))


def keep_first(docs: DataFrame, width: int = 5, least: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id (null last); columns unchanged.

    Of rows that repeat its id, one with the smallest text hash stays, and of rows that repeat both, one.
    Documents without words all stay.
    """
    number, hashed, chosen = (fresh(docs, x) for x in ("number", "hash", "of"))
    described, labels = classes(docs, width, least)
    whole = described.filter("size > 0").select("doc_id", "text_hash", "class").join(labels, "class", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = whole.groupBy(F.coalesce("label", "class").alias("part")).agg(first)
    kept = kept.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    dropped = whole.select("doc_id", "text_hash").join(kept, own, "left_anti").distinct()
    dropped = cut_lineage(dropped.select(F.col("doc_id").alias(chosen), F.col("text_hash").alias(hashed)))
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = F.col("doc_id").eqNullSafe(F.col(chosen)) & (F.xxhash64("text") == F.col(hashed))
    # the ids of what goes, fewer than those of what stays: if they are few, no text is shuffled
    rows = docs.filter(~empty).join(_told_small(dropped, dropped.count()), same, "left_anti")
    # rows alike in id and text: all but one are dropped, partly before the shuffle
    repeated = whole.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = cut_lineage(repeated.select(F.col("doc_id").alias(chosen), F.col("text_hash").alias(hashed)))
    repeated = _told_small(repeated, repeated.count())
    alike = rows.join(repeated, same, "left_semi").groupBy("doc_id", F.xxhash64("text").alias(hashed))
    one = alike.agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(number)).select(f"{number}.*")
    return rows.join(repeated, same, "left_anti").unionByName(one).unionByName(docs.filter(empty))
