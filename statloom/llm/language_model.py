"""Language-model scoring with a gated recurrent network and counts of the whole training corpus.

Words are counted over all training documents (``c``). The ``HEAD`` most frequent words are symbols
of the network (see ``recurrent``); every other word stands behind one of a few tail symbols, chosen by
the word's shape. A tail word's probability is that of its symbol times (c + 1) / (sum of c + 1 over
the known tail words of that shape, + 1 for all unknown ones together). The score of a document is the
log10 probability of all its words and its end, the state carried from its first word to its last.

The network is fitted in a few rounds of data-parallel reading: each task starts from the same
weights, reads its training documents once, and the weights are averaged by tokens read. Every training
document is read in one of the rounds, chosen by a hash of its id (a null id: of its text). Counts, vocabulary
and tail masses cover all of them too. Averages are the only thing on the driver, of a fixed size.

Counts of tail words reach the documents by a join: per slice of text one row for each different tail
word with the documents it occurs in. The head, which holds the words that could be a hot key, is a
table of fixed size and is sent to the tasks instead.

Null and empty texts have the end token only. A null id counts as the empty text in the fold. Repeated
rows get equal scores. Without training documents all counts are 0. Other columns are ignored. Words
are known by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import id_remainder, slices, texts
from statloom.llm.recurrent import GatedModel
from statloom.llm.words import REMEMBERED, hashed, split
from statloom.session import cut_lineage

HEAD = 1000
SHARE = 1
ROUNDS = 3
#: Bytes of text counted, or scored, at a time.
COUNTED, SCORED = 4 << 20, 3 << 20
#: Lanes read at a time when nothing is learned.
SCORE_LANES = 768
SHAPES = 8


def held_out(name: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return id_remainder(name, 7) == 2


def shape(word: bytes) -> int:
    """Whether all is ASCII, and whether it ends with a letter, a full stop, a comma or something else."""
    last = word[-1:]
    kind = 1 if last == b"." else 2 if last == b"," else 0 if last.isalnum() or last >= b"\x80" else 3
    return kind + 4 * (not word.isascii())


def word_counts(training: DataFrame) -> DataFrame:
    """``word`` (hash), ``shape``, ``n`` over all training documents, ends not included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", COUNTED):
            found: Counter[bytes] = Counter()
            for t in texts(batch, "text"):
                found.update(split(t))
            h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
            n = np.fromiter(found.values(), np.int64, len(found))
            shapes = np.fromiter(map(shape, found), np.int8, len(found))
            columns = {"word": pa.array(h.view(np.int64)), "shape": pa.array(shapes), "n": pa.array(n)}
            yield pa.record_batch(columns)

    counted = training.select("text").mapInArrow(run, "word long, shape byte, n long")
    return counted.groupBy("word", "shape").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The head words in order of their hash with their counts, the end's count, and the corpus totals."""

    words: np.ndarray
    counts: np.ndarray
    ends: int
    tokens: int
    types: int
    tail_counts: np.ndarray
    tail_types: np.ndarray

    @property
    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([[self.ends], self.counts, self.tail_counts])


class Symbols(dict):
    """Symbols of words: 0 is the end, then the head, then the tail's shapes."""

    def __init__(self, known: Vocabulary):
        super().__init__()
        self.head = {int(h): i + 1 for i, h in enumerate(known.words)}

    def __missing__(self, word: bytes) -> int:
        symbol = self.head.get(xxhash.xxh64_intdigest(word))
        symbol = len(self.head) + 1 + shape(word) if symbol is None else symbol
        if len(self) < REMEMBERED:
            self[word] = symbol
        return symbol

    def of(self, text: bytes) -> np.ndarray:
        """The symbols of a whole text and its end."""
        words = split(text)
        out = np.zeros(len(words) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return out


def vocabulary(counts: DataFrame, n_documents: int, head: int = HEAD) -> Vocabulary:
    rows = counts.orderBy(F.col("n").desc(), "word").limit(head).collect()  # `head` rows at most
    rows = sorted(rows, key=lambda r: r["word"] & (2**64 - 1))
    totals = counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()  # SHAPES rows
    tail_counts, tail_types = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in totals:
        tail_counts[r["shape"]], tail_types[r["shape"]] = r["n"], r["types"]
    tokens, types = int(tail_counts.sum()) + n_documents, int(tail_types.sum()) + (n_documents > 0)
    for r in rows:
        tail_counts[r["shape"]] -= r["n"]
        tail_types[r["shape"]] -= 1
    words = np.array([r["word"] for r in rows], dtype=np.int64).view(np.uint64)
    return Vocabulary(words, np.array([r["n"] for r in rows], np.int64), n_documents, tokens, types, tail_counts, tail_types)


def turn_key() -> Column:
    """What decides in which round a document is read: its id, or its text where that is null."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("turn"), "text")).otherwise(F.xxhash64(F.lit("turn"), "doc_id"))


def fit(training: DataFrame, known: Vocabulary, share: int = SHARE, rounds: int = ROUNDS) -> GatedModel:
    """Average the weights of one reading per task, round by round."""
    model, context = GatedModel(known.symbol_counts), training.sparkSession.sparkContext
    turn = F.pmod(turn_key(), F.lit(share * rounds))
    for k in range(rounds):
        start = context.broadcast((model.flat(), known))  # a fixed size

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            weights, words = start.value
            own, memory, read = GatedModel(words.symbol_counts).set_flat(weights), None, 0
            symbols = Symbols(words)
            for batch in slices(batches, "text", SCORED):
                docs = [symbols.of(t) for t in texts(batch, "text")]
                memory = own.train(docs, memory)
                read += sum(map(len, docs))
            if read:
                flat = own.flat()
                yield pa.record_batch(
                    {
                        "at": pa.array(np.arange(len(flat)), pa.int32()),
                        "read": pa.array(np.full(len(flat), float(read))),
                        "value": pa.array(flat * read),
                    }
                )

        read = training.filter(turn == k).select("text").mapInArrow(run, "at int, read double, value double")
        mean = read.groupBy("at").agg((F.sum("value") / F.sum("read")).alias("value")).orderBy("at").collect()
        if mean:
            model.set_flat(np.array([r["value"] for r in mean]))
    return model


def _tails(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """``word``, ``docs``: the tail words of each slice of text with the documents they occur in."""
    shipped = docs.sparkSession.sparkContext.broadcast(known)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shipped.value.words
        for batch in slices(batches, "text", COUNTED):
            documents = [split(t) for t in texts(batch, "text")]
            h = hashed([w for d in documents for w in d])
            keys = np.repeat(batch.column("doc_key").to_numpy(zero_copy_only=False), [len(d) for d in documents])
            tail = ~np.isin(h, head)
            h, keys = h[tail], keys[tail]
            order = np.argsort(h, kind="stable")
            words, first = np.unique(h[order], return_index=True)
            ends = pa.array(np.append(first, len(h)), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(keys[order], pa.int64()))
            yield pa.record_batch({"word": pa.array(words.view(np.int64)), "docs": lists})

    return docs.select("doc_key", "text").mapInArrow(run, "word long, docs array<long>")


def _network(docs: DataFrame, known: Vocabulary, model: GatedModel) -> DataFrame:
    """What the head and the network say of each document."""
    shipped = docs.sparkSession.sparkContext.broadcast((known, model))  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, network = shipped.value
        n_head, symbols = len(words.words), Symbols(words)
        masses = np.log10(words.tail_counts + words.tail_types + 1)
        # log10(c + 1) of head symbols, and minus the log mass of tail symbols
        base = np.concatenate([np.log10(np.append(words.ends, words.counts) + 1), np.zeros(SHAPES)])
        tails = np.concatenate([np.zeros(n_head + 1), masses])
        seen = np.concatenate([[words.ends > 0], np.ones(n_head, bool), np.zeros(SHAPES, bool)])
        for batch in slices(batches, "text", SCORED):
            docs = [symbols.of(t) for t in texts(batch, "text")]
            log_p = network.log_likelihood(docs, SCORE_LANES) / np.log(10)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "doc_key": batch.column("doc_key"),
                    "n_tokens": pa.array([len(d) for d in docs], pa.int64()),
                    "head_known": pa.array([int(seen[d].sum()) for d in docs], pa.int64()),
                    "head_sum": pa.array([float(base[d].sum()) for d in docs], pa.float64()),
                    "symbols": pa.array([float(p - tails[d].sum()) for p, d in zip(log_p, docs)], pa.float64()),
                }
            )

    schema = "doc_id long, doc_key long, n_tokens long, head_known long, head_sum double, symbols double"
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, learns: Column | None = None, head: int = HEAD, share: int = SHARE) -> DataFrame:
    """Every document with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10)."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    training = rows.filter(~held_out() if learns is None else learns)
    counts = cut_lineage(word_counts(training))
    known = vocabulary(counts, training.select("doc_id").count(), head)
    model = fit(training, known, share)
    scored = cut_lineage(_network(rows, known, model))
    found = _tails(rows, known).join(counts.select("word", "n"), "word")
    found = found.select(F.log10(F.col("n") + 1).alias("l"), F.explode("docs").alias("_key"))
    tail = found.groupBy("_key").agg(F.sum("l").alias("tail_sum"), F.count("*").alias("tail_known"))
    # rows that repeat a document added to the same sums
    alike = scored.groupBy(F.col("doc_key").alias("_key")).agg(F.count("*").alias("alike"))
    sums = alike.join(tail, "_key", "left")
    out = scored.join(sums, F.col("doc_key") == F.col("_key"))
    tail_sum = F.coalesce(F.col("tail_sum") / F.col("alike"), F.lit(0.0))
    tail_known = F.coalesce((F.col("tail_known") / F.col("alike")).cast("long"), F.lit(0).cast("long"))
    smoothed = F.log10(F.lit(float(known.tokens + known.types + 1)))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + tail_known).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + tail_sum - F.col("n_tokens") * smoothed).alias("base_score"),
        (F.col("symbols") + tail_sum).alias("score"),
    )
