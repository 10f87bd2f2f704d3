"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets of like lengths. A query's k-th best score among the
longest vectors is a lower bound for its final k-th score. Against each bucket the bound gives a local
cosine threshold: bound / (query length * longest length in the bucket).

* Above 1 the bucket is skipped.
* A high threshold prunes by coordinates: a vector can only reach it if, in each of the query's
  largest coordinates, its normalised value lies in the interval that the threshold leaves.
* A low one prunes by length: only vectors of length bound / query length or more are looked at.

What passes is verified by integer products. Buckets and query blocks have a bounded number of rows
and meet in pairs: every block of the stated query set against every bucket, spread over the tasks. Only
the first bucket is broadcast, for the bounds; the repeated query blocks are merged with the buckets, because
Spark would take their size for that of the table they are repeated from, and send them all to the driver.

Vectors that are null, or hold null or non-finite components, take no part; neither do rows without
an id. Rows that share an id count once, with the smallest vector. Shorter vectors are filled with
zeros. Ties go to the smaller id. Products too large for 64 bits are found exactly in Python numbers
and held to the range of long. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.ordered import in_parts, running
from statloom.session import cut_lineage

K = 20
BUCKET = 2048
BLOCK = 256
#: Coordinates looked at, and the cosine threshold from which they are.
FOCUS = 6
HIGH = 0.85
#: Sums of products below this are exact in float64.
EXACT = 2.0**52

_BLOCK = "block long, ids binary, vectors binary, width int"


def integers(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) of every component as double, one row per id."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _packed(rows: list[tuple[int, list[float]]], block: int) -> pa.RecordBatch:
    width = max(len(v) for _, v in rows)
    matrix = np.zeros((len(rows), width))
    for i, (_, v) in enumerate(rows):
        matrix[i, : len(v)] = v
    return pa.record_batch(
        {
            "block": pa.array([block], pa.int64()),
            "ids": pa.array([np.array([i for i, _ in rows], dtype="<i8").tobytes()], pa.binary()),
            "vectors": pa.array([matrix.astype("<f8").tobytes()], pa.binary()),
            "width": pa.array([width], pa.int32()),
        }
    )


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed into blocks of ``size``, longest first, numbered from 0."""
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    keyed = rows.withColumn("_length", length)
    order = [F.col("_length").desc(), F.col("vec_id").asc()]
    placed = running(in_parts(keyed, [], order), [], order, {"_place": F.lit(1).cast("long")})
    numbered = placed.select("vec_id", "v", F.col("_length").alias("length"), F.floor((F.col("_place") - 1) / size).cast("long").alias("block"))

    def pack(table: pa.Table) -> pa.Table:
        # one block: at most `size` vectors, longest first whatever order they came in
        table = table.sort_by([("length", "descending"), ("vec_id", "ascending")])
        ids, vectors = table.column("vec_id").to_pylist(), table.column("v").to_pylist()
        return pa.Table.from_batches([_packed(list(zip(ids, vectors)), table.column("block")[0].as_py())])

    return cut_lineage(numbered.groupBy("block").applyInArrow(pack, _BLOCK))


def _matrix(ids: bytes, vectors: bytes, width: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, "<i8")
    matrix = np.zeros((len(keys), to))
    matrix[:, :width] = np.frombuffer(vectors, "<f8").reshape(len(keys), width)
    return keys, matrix


def by_coordinates(query: np.ndarray, length: float, matrix: np.ndarray, lengths: np.ndarray, threshold: float) -> np.ndarray:
    """Rows whose largest-coordinate intervals allow a cosine of ``threshold`` with the query."""
    rows, unit = np.arange(len(matrix)), query / length
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        # cosine >= threshold bounds the angle, and with it the distance from the query's coordinate
        least = abs(unit[f]) * threshold - np.sqrt(max(0.0, (1 - threshold**2) * (1 - unit[f] ** 2))) - 1e-9
        rows = rows[np.sign(unit[f]) * matrix[rows, f] >= least * lengths[rows]]
    return rows


def _best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best allowed entries of each row, ties to the smaller id."""
    held = np.where(allowed, scores, -np.inf)
    if held.shape[1] > k:
        allowed = allowed & (held >= np.partition(held, -k, axis=1)[:, [-k]])
    row, column = np.nonzero(allowed)
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def matched(qids, queries, bounds: list[int | None], ids, matrix, k: int) -> list[tuple[int, int, int]]:
    """(query, row, score): the best ``k`` rows of a bucket for each query, if they reach its bound.

    Queries whose threshold is low meet the bucket together, each with the rows that are long enough.
    """
    lengths = np.sqrt((matrix**2).sum(axis=1))
    if np.abs(queries).max(initial=0) * np.abs(matrix).max(initial=0) * max(matrix.shape[1], 1) >= EXACT:
        return _exactly(qids, queries, bounds, ids, matrix, k)
    q_lengths = np.sqrt((queries**2).sum(axis=1))
    bound = np.array([-np.inf if b is None else float(b) for b in bounds])
    free = (bound <= 0) | (q_lengths == 0)
    slack = 1 - 1e-9  # rounding in lengths must not lose a vector
    need = np.where(free, 0.0, bound * slack / np.maximum(q_lengths, 1e-300))
    threshold = need / max(lengths.max(initial=0), 1e-300)
    few = np.where(free, len(lengths), np.searchsorted(-lengths, -need, "right"))
    # a query of length 0 reaches only bounds up to 0
    alive = (few > 0) & (threshold <= 1) & ((q_lengths > 0) | (bound <= 0))
    out: list[tuple[int, int, int]] = []

    def add(which: np.ndarray, rows: np.ndarray, enough: np.ndarray) -> None:
        scores = queries[which] @ matrix[rows].T
        allowed = enough & (scores >= bound[which, None]) & (ids[rows] != qids[which, None])
        r, c = _best(scores, allowed, ids[rows], k)
        out.extend(zip(qids[which[r]].tolist(), ids[rows[c]].tolist(), scores[r, c].astype(np.int64).tolist()))

    together = np.flatnonzero(alive & (threshold < HIGH))
    if len(together):
        rows = np.arange(int(few[together].max()))
        add(together, rows, rows[None, :] < few[together, None])
    for q in np.flatnonzero(alive & (threshold >= HIGH)):
        rows = by_coordinates(queries[q], q_lengths[q], matrix[: few[q]], lengths[: few[q]], threshold[q])
        if len(rows):
            add(np.array([q]), rows, np.ones((1, len(rows)), bool))
    return out


def _exactly(qids, queries, bounds, ids, matrix, k: int) -> list[tuple[int, int, int]]:
    """The same in Python numbers, for products that float64 cannot hold."""
    whole, out = [[int(x) for x in row] for row in matrix], []
    for qid, query, bound in zip(qids.tolist(), queries, bounds):
        q = [int(x) for x in query]
        scores = [(-sum(a * b for a, b in zip(q, row)), i) for row, i in zip(whole, ids.tolist()) if i != qid]
        held = [(qid, i, max(-_LONG, min(_LONG, -s))) for s, i in sorted(scores)[:k]]
        out += [h for h in held if bound is None or h[2] >= bound]
    return out


_HITS = "q_block long, query_id long, vec_id long, score long"
_LONG = 2**63 - 1


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query in each pair of blocks, if they reach the query's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pair = batch.slice(row, 1).to_pylist()[0]
                width = max(pair["q_width"], pair["width"])
                qids, queries = _matrix(pair["q_ids"], pair["q_vectors"], pair["q_width"], width)
                ids, matrix = _matrix(pair["ids"], pair["vectors"], pair["width"], width)
                known = {b["query_id"]: b["bound"] for b in pair["bounds"] or ()}
                out = matched(qids, queries, [known.get(q) for q in qids.tolist()], ids, matrix, k)
                columns = [pa.array(c, pa.int64()) for c in (list(zip(*out)) or [(), (), ()])]
                block = pa.array([pair["q_block"]] * len(out), pa.int64())
                yield pa.RecordBatch.from_arrays([block, *columns], ["q_block", "query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, _HITS)


def top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: float = 64.0) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best other vectors of every query row."""
    rows = cut_lineage(integers(vectors, scale))
    buckets = blocks(rows, BUCKET)
    asked = blocks(rows.filter(is_query), BLOCK).select(
        F.col("block").alias("q_block"),
        F.col("ids").alias("q_ids"),
        F.col("vectors").alias("q_vectors"),
        F.col("width").alias("q_width"),
    )
    unbounded = F.lit(None).cast("array<struct<query_id:long,bound:long>>")
    longest = asked.withColumn("bounds", unbounded).crossJoin(F.broadcast(buckets.filter("block = 0")))
    lowest = top(_search(longest, k), k).groupBy("q_block", "query_id").agg(F.min("score").alias("bound"), F.count("*").alias("n"))
    # at most one entry per query of a block
    bounds = lowest.filter(F.col("n") >= k).groupBy("q_block").agg(F.collect_list(F.struct("query_id", "bound")).alias("bounds"))
    bounded = cut_lineage(asked.join(bounds, "q_block", "left"))
    n_buckets = buckets.agg(F.max("block") + 1).first()[0] or 0
    every = F.explode(F.sequence(F.lit(0), F.lit(max(n_buckets - 1, 0)).cast("long")))
    pairs = bounded.withColumn("block", every).join(buckets.hint("merge"), "block")
    return top(_search(pairs, k), k).select("query_id", "rank", "vec_id", "score")
