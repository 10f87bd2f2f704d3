"""Importance resampling towards a target distribution of hashed word runs.

A table of 256 bytes lowers A-Z and blanks all other ASCII bytes except 0-9 and a-z; ``bytes.split`` then
yields the words of the UTF-8 text. A feature is a run of one to three words joined by one blank. Its hash
is chained: the crc32 of a run is the seed with which a blank and the next word continue it, so a run is
never built. A feature's bucket is the crc32 modulo the number of buckets.

Counters add up the buckets inside a task and Spark adds up the tasks, once for the documents and once for
the target texts. What a bucket gains is a table with one number per bucket; the driver makes it and the
scoring pass carries it. Both passes read the texts as they lie: no text is shuffled.

A document's weight is the sum of its features' gains, and its score adds noise drawn from its id, so the
highest scores are a sample without replacement in proportion to exp(weight / 1000). Ranks come from range
partitions ordered by score: a part numbers its own rows and adds the sizes of earlier parts.

Null texts have no words, no features, weight 0 and are not drawn, like all documents below the least
number of words. A null id draws the noise of the empty id and comes after other ids of the same score.
Repeated rows are drawn one by one. Very long texts are handled in pieces. Empty documents give no rows;
an empty target gives the gains that T = t = 0 give. Documents keep their columns in the struct ``row``,
so that their names cannot clash with the results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import row_of, slices, texts
from statloom.llm.ordered import in_parts, running
from statloom.session import cut_lineage

#: A-Z lowered, other ASCII bytes except 0-9 and a-z to a blank, the bytes of other characters as they are.
TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
LONGEST = 3
BUCKETS = 10_000
SCALE = 1000
SEED = 42
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
#: Percentage of the other documents that is drawn.
PERCENT = 5
#: Bytes of one text whose words are listed at a time.
PIECE_BYTES = 1 << 20


# --- features ------------------------------------------------------------------------------------------


def pieces(text: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """Cut a text at blanks into pieces of about ``limit`` bytes; a longer word stays whole."""
    start = 0
    while start < len(text):
        stop = text.find(b" ", start + limit)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop]
        start = stop


def features(text: bytes, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, crc32 of every feature) of each piece of a text."""
    carried: list[bytes] = []
    for piece in pieces(text.translate(TABLE), limit):
        words = carried + piece.split()
        known = len(carried)
        runs = list(map(crc32, words))
        lists = [runs[known:]]
        spaced = [b" " + w for w in words]
        for more in range(1, LONGEST):
            runs = list(map(crc32, spaced[more:], runs))
            # a run whose last word is carried was counted with the piece before
            lists.append(runs[max(known - more, 0) :])
        n = sum(map(len, lists))
        yield len(words) - known, np.fromiter(chain.from_iterable(lists), np.uint32, n)
        carried = words[1 - LONGEST :]


def bucket_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """bucket, n: how often each bucket occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in slices(batches, "text"):
            for value in texts(batch, "text"):
                for _, hashes in features(value):
                    found.update((hashes % BUCKETS).tolist())
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array(found.keys(), pa.int32()), "n": pa.array(found.values(), pa.int64())}
        )

    per_task = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """What one occurrence of each bucket adds to a weight."""
    s_all, t_all = float(sum(source.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    return np.array(
        [
            math.floor(SCALE * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all)))
            for b in range(BUCKETS)
        ],
        dtype=np.int64,
    )


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text") -> np.ndarray:
    """The gains from all documents and all target texts; at most ``BUCKETS`` rows reach the driver from each."""
    return gains(
        {r["bucket"]: r["n"] for r in bucket_counts(docs, text).collect()},
        {r["bucket"]: r["n"] for r in bucket_counts(target, text).collect()},
    )


# --- weights and scores --------------------------------------------------------------------------------


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """row, n_words, n_features, weight: a row for every document, with the columns ``keep`` (all) in ``row``."""
    read = docs.select(row_of(docs, keep), F.col(text).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = []
            for value in texts(batch, "text"):
                words = n = weight = 0
                for new, hashes in features(value):
                    words += new
                    n += len(hashes)
                    weight += int(gain[hashes % BUCKETS].sum())
                found.append((words, n, weight))
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", "n_words", "n_features", "weight"])

    longs = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    return read.mapInArrow(judge, T.StructType([read.schema["row"], *longs]))


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise from the id, in whole units of the weight."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return F.floor(-float(SCALE) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] | None = None,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """row, n_words, n_features, weight, score, rank: every document; ``rank`` is null where it is not drawn."""
    keep = list(docs.columns if keep is None else keep)
    keep += [key] if key not in keep else []
    weighed = weigh(docs, bucket_gains(docs, target, text), text, keep)
    id_ = F.col("row")[key]
    scored = weighed.withColumn("score", F.col("weight") + noise(id_, seed)).withColumn("place", F.monotonically_increasing_id())
    scored = cut_lineage(scored)
    drawable = scored.where(F.col("n_words") >= least_words)
    n_drawn = percent * drawable.count() // 100
    # the place in the scan only tells apart rows that have both the id and the score in common
    order = [F.col("score").desc(), id_.asc_nulls_last(), F.col("place")]
    ranked = running(in_parts(drawable, [], order), [], order, {"rank": F.lit(1).cast("long")})
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(short).drop("place")


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """Only the drawn documents, with the columns they came with, best first within range partitions."""
    return resample(docs, target, **options).where(F.col("rank").isNotNull()).select("row.*")
