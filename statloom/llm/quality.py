"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum_j w_j x_j + sum_{i<j} <v_i, v_j> x_i x_j), where the pair sum is computed in
linear time as half of sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2).

Inputs are the words of the whole text (A-Z lowered, hashed by crc32 into ``BUCKETS``, counts scaled
to unit length), figures of its structure, and the metadata column ``n_chars``. Labels, language,
source and id are never inputs.

The model is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hash of their id, and
sent to the tasks; its size is fixed by ``BUCKETS`` and ``FACTORS``. Scoring is one pass without a shuffle.

Null text is empty; a null ``n_chars`` counts as the length of the text. A document with several
labels has the highest; null labels are ignored. Without labelled rows every score is 0.5. Repeated
rows get equal scores. Other columns are passed on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import fresh, id_remainder, lowered, slices, texts

BUCKETS = 1 << 15
FACTORS = 4
SAMPLE = 12_000
EPOCHS = 12
BATCH = 128
RATE = 0.08
SHRINK = 1e-5
SEED = 20

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
COMMON_MARKS = b".,'\"-;:()?"
STRUCTURE = 12


@dataclass
class Features:
    """Sparse rows: ``row`` is ascending, one entry per feature of a row."""

    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    rows: int


def structure(text: bytes, words: list[bytes], distinct: int, top: int, n_chars: int) -> list[float]:
    size, n = max(len(text), 1), max(len(words), 1)
    lines = text.split(b"\n")
    marks = size - len(text.translate(None, MARKS))
    rare = marks - (size - len(text.translate(None, COMMON_MARKS)))
    return [
        (size - len(text.translate(None, UPPER))) / size,
        (size - len(text.translate(None, DIGITS))) / size,
        min(marks / n, 4) / 4,
        min(rare / n, 4) / 4,
        min(text.count(b"|") / n, 1),
        min(text.count(b"!") / n, 1),
        distinct / n,
        top / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        min(np.log1p(n) / 12, 1),
        min(np.log1p(n_chars) / 15, 1),
    ]


def features(documents: list[bytes], n_chars: list[int | None]) -> Features:
    split = [lowered(d).split() for d in documents]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    hashed = np.fromiter((zlib.crc32(x) for w in split for x in w), np.int64, int(sizes.sum())) % BUCKETS
    keys, counts = np.unique(np.repeat(np.arange(len(split)), sizes) * BUCKETS + hashed, return_counts=True)
    row, feature = keys // BUCKETS, keys % BUCKETS
    norm = np.sqrt(np.bincount(row, counts.astype(float) ** 2, len(split)))
    value = counts / norm[row]
    distinct = np.bincount(row, minlength=len(split))
    top = np.zeros(len(split), dtype=np.int64)
    np.maximum.at(top, row, counts)
    extra = np.array(
        [
            structure(d, w, int(k), int(t), len(d.decode()) if n is None else max(n, 0))
            for d, w, k, t, n in zip(documents, split, distinct, top, n_chars)
        ]
    ).reshape(-1, STRUCTURE)
    r = np.repeat(np.arange(len(split)), STRUCTURE)
    f = BUCKETS + np.tile(np.arange(STRUCTURE), len(split))
    order = np.argsort(np.concatenate([row, r]), kind="stable")
    return Features(
        np.concatenate([row, r])[order],
        np.concatenate([feature, f])[order],
        np.concatenate([value, extra.ravel()])[order],
        len(split),
    )


class FactorisationMachine:
    def __init__(self, n_features: int = BUCKETS + STRUCTURE, factors: int = FACTORS, seed: int = SEED):
        self.bias = 0.0
        self.weights = np.zeros(n_features)
        self.vectors = np.random.default_rng(seed).normal(0, 0.05, (factors, n_features))

    def margins(self, x: Features) -> np.ndarray:
        """Linear time: one pass over the entries per factor."""
        out = self.bias + np.bincount(x.row, self.weights[x.feature] * x.value, x.rows)
        for v in self.vectors:
            part = v[x.feature] * x.value
            out += 0.5 * (np.bincount(x.row, part, x.rows) ** 2 - np.bincount(x.row, part**2, x.rows))
        return out

    def scores(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -60, 60)))

    def fit(self, x: Features, labels: np.ndarray) -> FactorisationMachine:
        """AdaGrad on the logistic loss, in a fixed pseudo-random order."""
        random, n = np.random.default_rng(SEED), len(self.weights)
        bounds = np.searchsorted(x.row, np.arange(x.rows + 1))
        seen = [1e-8, np.full(n, 1e-8), np.full(self.vectors.shape, 1e-8)]
        for _ in range(EPOCHS):
            order = random.permutation(x.rows)
            for start in range(0, x.rows, BATCH):
                rows = order[start : start + BATCH]
                at = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
                lengths = bounds[rows + 1] - bounds[rows]
                b = Features(np.repeat(np.arange(len(rows)), lengths), x.feature[at], x.value[at], len(rows))
                error = (self.scores(b) - labels[rows]) / len(rows)
                g = error[b.row] * b.value
                slope = float(error.sum())
                seen[0] += slope**2
                used = np.unique(b.feature)
                grads = []
                for v in self.vectors:
                    part = np.bincount(b.row, v[b.feature] * b.value, b.rows)
                    grads.append(np.bincount(b.feature, g * (part[b.row] - v[b.feature] * b.value), n)[used])
                slopes = np.bincount(b.feature, g, n)[used] + SHRINK * self.weights[used]
                seen[1][used] += slopes**2
                self.bias -= RATE * slope / np.sqrt(seen[0])
                self.weights[used] -= RATE * slopes / np.sqrt(seen[1][used])
                for f, grad in enumerate(grads):
                    grad = grad + SHRINK * self.vectors[f, used]
                    seen[2][f, used] += grad**2
                    self.vectors[f, used] -= RATE * grad / np.sqrt(seen[2][f, used])
        return self


def _counts(batch: pa.RecordBatch) -> list[int | None]:
    return batch.column("n_chars").to_pylist()


def _inputs(docs: DataFrame) -> DataFrame:
    return docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("long"))


def learn(docs: DataFrame, labels: DataFrame, learns: Column, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on the labelled documents for which ``learns`` (a condition on ``doc_id``) holds."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learns)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("_label"))
    # a bounded sample: at most `sample` rows
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = _inputs(docs).select("doc_id", "text", "n_chars").join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(texts(batch, "text"), _counts(batch))
            bounds = np.searchsorted(x.row, np.arange(x.rows + 1))
            cut = [slice(a, b) for a, b in zip(bounds, bounds[1:])]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "label": batch.column("_label").cast(pa.int32()),
                    "feature": pa.array([x.feature[c].astype("<i4").tobytes() for c in cut], pa.binary()),
                    "value": pa.array([x.value[c].astype("<f4").tobytes() for c in cut], pa.binary()),
                }
            )

    found = rows.mapInArrow(run, "doc_id long, label int, feature binary, value binary")
    # rows that repeat a document could exceed the bound
    found = found.orderBy("doc_id", "feature", "value").limit(sample).collect()
    model = FactorisationMachine()
    if not found:
        model.vectors[:] = 0
        return model
    sizes = [len(r["feature"]) // 4 for r in found]
    x = Features(
        np.repeat(np.arange(len(found)), sizes),
        np.concatenate([np.frombuffer(r["feature"], "<i4") for r in found]).astype(np.int64),
        np.concatenate([np.frombuffer(r["value"], "<f4") for r in found]).astype(float),
        len(found),
    )
    return model.fit(x, np.array([float(r["label"] > 0) for r in found]))


def score(docs: DataFrame, model: FactorisationMachine, name: str = "_score") -> DataFrame:
    """``docs`` with the model's score of every whole text in column ``name``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: BUCKETS * (FACTORS + 1) numbers
    given = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(texts(batch, "text"), _counts(batch))
            columns = [batch.column(c) for c in given] + [pa.array(shipped.value.scores(x))]
            yield pa.RecordBatch.from_arrays(columns, [*given, name])

    if name.lower() in (c.lower() for c in given):
        raise ValueError(f"the documents have a column {name} already")
    schema = docs.withColumn(name, F.lit(0.0)).schema
    return _inputs(docs).mapInArrow(run, schema)


def held_out(name: str = "doc_id") -> Column:
    """The fold whose labels are never learned from."""
    return id_remainder(name, 3) == 1


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents scored ``least`` or more, with the same columns."""
    model = learn(docs, labels, ~held_out())
    name = fresh(docs, "_score")
    return score(docs, model, name).filter(F.col(name) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
