"""Token-id files: frequency-ranked ids, byte-aligned variable-length codes, separate control bytes.

Ids are replaced by their rank in the frequency order of the whole corpus, so that frequent ids take
one byte. Four ranks share one control byte that holds their lengths (two bits each, length - 1); the
value bytes, little end first, follow in a separate stream. A decoder looks the control bytes up in a
256-row table of lengths and gathers the value bytes with numpy: no loop over values.

A file set is a folder with two tables (a third, ``ids``, is left from writing):

* ``docs``: one row per document in ascending id order (``part``, then ``seq``): ``doc_id``,
  ``offset`` (ids before it in its part), ``n_tokens``, ``control``, ``data``;
* ``ranks``: ``rank``, ``token_id``, ``n``. Its size is bounded by the vocabulary.

Null text is empty; an empty text has only the end id. A null ``doc_id`` sorts first. Rows that share
a ``doc_id`` are ordered by their text. An empty table gives empty tables. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.llm.common import slices, texts

END_ID = 2
#: Words a Python worker remembers with their ids; beyond that it starts anew.
REMEMBERED = 1_200_000
#: Plain texts hold these ASCII bytes (an apostrophe can start a piece that goes on with letters) ...
PLAIN = b" \t\n\v\f\r" + bytes(b for b in range(33, 127) if b != 39)
#: ... and Latin-1 letters in UTF-8: U+00C0 to U+00FF without the times and division signs, capitals to U+00DE.
LATIN = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
CAPITAL = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")
#: The pieces of a plain lower-case text: letters, marks, or one digit.
PIECE = re.compile(rb"[a-z\x80-\xff]+|[!-/:-@\[-`{-~]+|[0-9]")
#: Byte-level vocabularies write each byte as a visible character: printable Latin-1 as itself, the
#: others in order from U+0100 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*VISIBLE}))}
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)

DOCS_SCHEMA = "part int, seq long, doc_id long, offset long, n_tokens long, control binary, data binary"


class WordIds(dict):
    """Ids of whole texts through the tokenizers library, its model asked once per different piece.

    The tokenizer normalises, cuts a text into runs of letters, single digits and runs of marks, and
    merges within each. In plain texts (ASCII and Latin-1 letters, digits, white space, marks) one
    pattern finds these pieces; words of any other text go through the whole tokenizer. The mapping
    itself remembers the ids (uint32, as bytes) of lower-case words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = True

    def _piece(self, piece: bytes) -> bytes:
        model = self.tokenizer.model
        return array("I", [t.id for t in model.tokenize(piece.decode("latin-1").translate(BYTE_CHARS))]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if not self.plain:
            return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        pieces = PIECE.findall(word)
        ids = self[word] = self._piece(word) if len(pieces) == 1 else b"".join([self[p] for p in pieces])
        return ids

    def __call__(self, documents: list[bytes], end: int = END_ID) -> list[np.ndarray]:
        get, last, out = self.__getitem__, array("I", [end]).tobytes(), []
        if len(self) > REMEMBERED:
            self.clear()
        for d in documents:
            low = d.lower()
            self.plain = b"<|" not in d and not LATIN.sub(b"", low.translate(None, PLAIN))
            words = CAPITAL.sub(lambda m: b"\xc3" + bytes([m[0][1] + 32]), low).split() if self.plain else d.split()
            # words of other texts may be known from plain ones, but as their lower-case form only
            ids = map(get if self.plain else self.__missing__, words)
            out.append(np.frombuffer(b"".join(ids) + last, dtype=np.uint32))
        return out


_READY: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per Python worker, kept between tasks."""
    if path not in _READY:
        _READY[path] = WordIds(path)
    return _READY[path]


def pack(documents: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Control and value bytes of each document; its last group of four is filled with 0."""
    sizes = np.array([len(x) for x in documents], dtype=np.int64)
    groups = -(-sizes // 4)
    ends = np.cumsum(4 * groups)
    full = np.zeros(int(ends[-1]) if len(ends) else 0, dtype="<u4")
    for x, end, padded in zip(documents, ends, 4 * groups):
        full[end - padded : end - padded + len(x)] = x
    width = max(1, -(-int(full.max(initial=0)).bit_length() // 8))
    used = np.ones((len(full), width), dtype=bool)
    for k in range(1, width):
        np.greater(full, (1 << 8 * k) - 1, out=used[:, k])
    lengths = used.sum(axis=1, dtype=np.uint8)
    extra = lengths.reshape(-1, 4) - np.uint8(1)
    control = extra[:, 0] | extra[:, 1] << 2 | extra[:, 2] << 4 | extra[:, 3] << 6
    data = full.view(np.uint8).reshape(-1, 4)[:, :width][used]
    data_ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[ends]
    return _binary(control, np.cumsum(groups)), _binary(data, data_ends)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpack(control: bytes, data: bytes) -> np.ndarray:
    """The ranks of any number of packed documents laid end to end, fill values included."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()
    starts = np.cumsum(lengths, dtype=np.int32) - lengths
    values = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    ranks = values[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        ranks |= np.where(lengths > k, values[starts + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _rows(columns: dict, numbers: list[np.ndarray]) -> pa.RecordBatch:
    control, data = pack(numbers)
    return pa.record_batch(columns | {"control": control, "data": data})


def encode(docs: DataFrame, tokenizer: str, end: int = END_ID) -> DataFrame:
    """Packed token ids (not yet ranks) of every document, cut into parts in ascending id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, offset = TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, "text"):
            encoded = word_ids(tokenizer)(texts(batch, "text"), end)
            sizes = np.array([len(x) for x in encoded], dtype=np.int64)
            n = len(sizes)
            columns = {
                "part": pa.array(np.full(n, part), pa.int32()),
                "seq": pa.array(np.arange(seq, seq + n), pa.int64()),
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "offset": pa.array(offset + np.cumsum(sizes) - sizes, pa.int64()),
                "n_tokens": pa.array(sizes, pa.int64()),
            }
            yield _rows(columns, encoded)
            seq, offset = seq + n, offset + int(sizes.sum())

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, DOCS_SCHEMA)


def _each(batches: Iterator[pa.RecordBatch], of: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The packed numbers of every row, mapped through ``of``."""
    for batch in slices(batches, "data"):
        controls = batch.column("control").to_pylist()
        numbers = unpack(b"".join(controls), b"".join(batch.column("data").to_pylist()))
        numbers = numbers if of is None else of[numbers]
        ends = np.cumsum([4 * len(c) for c in controls])
        first = ends - [4 * len(c) for c in controls]
        yield batch, [numbers[i : i + n] for i, n in zip(first, batch.column("n_tokens").to_pylist())]


def id_counts(encoded: DataFrame) -> DataFrame:
    """How often each id occurs in the whole corpus: ``token_id``, ``n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for _, ids in _each(batches):
            seen = np.bincount(np.concatenate(ids), minlength=len(total))
            seen[: len(total)] += total
            total = seen
        found = np.flatnonzero(total)
        yield pa.record_batch({"token_id": pa.array(found, pa.int64()), "n": pa.array(total[found], pa.int64())})

    counts = encoded.select("n_tokens", "control", "data").mapInArrow(count, "token_id long, n long")
    return counts.groupBy("token_id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END_ID) -> None:
    """Encode ``doc_id``, ``text`` and write the file set described above to ``folder``.

    Each text is tokenized once: the ids are first written as they are (folder ``ids``), counted, and
    written again as ranks.
    """
    spark = docs.sparkSession
    encode(docs, tokenizer, end).write.option("compression", "zstd").parquet(f"{folder}/ids")
    encoded = spark.read.schema(DOCS_SCHEMA).parquet(f"{folder}/ids")
    # at most one row per id of the vocabulary
    counts = sorted(id_counts(encoded).collect(), key=lambda r: (-r["n"], r["token_id"]))
    ids = [r["token_id"] for r in counts]
    spark.createDataFrame(
        [(rank, r["token_id"], r["n"]) for rank, r in enumerate(counts)], "rank long, token_id long, n long"
    ).coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(max(ids, default=0) + 1, dtype=np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    plain = ("part", "seq", "doc_id", "offset", "n_tokens")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ranks in _each(batches, rank_of):
            yield _rows({c: batch.column(c) for c in plain}, ranks)

    encoded.mapInArrow(rank, DOCS_SCHEMA).write.option("compression", "zstd").parquet(f"{folder}/docs")


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """``part`` and ``base``, the ids in all earlier parts: one row per part."""
    totals = spark.read.schema(DOCS_SCHEMA).parquet(f"{folder}/docs").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Decode a file set: ``doc_id``, ``start``, ``n_tokens``, ``ids`` (array of int)."""
    return _decoded(spark, folder, "ids array<int>", lambda x: x.astype(np.int32))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Decode a file set and sum each document up: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    return _decoded(spark, folder, "ids_crc32 long", lambda x: zlib.crc32(x.astype("<u4").tobytes()))


def _decoded(spark: SparkSession, folder: str, field: str, make) -> DataFrame:
    name = field.split()[0]
    # bounded by the vocabulary
    ranks = sorted((r["rank"], r["token_id"]) for r in spark.read.parquet(f"{folder}/ranks").collect())
    id_of = np.array([t for _, t in ranks] or [0], dtype=np.uint32)
    kind = pa.list_(pa.int32()) if "array" in field else pa.int64()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in _each(batches, id_of):
            columns = {c: batch.column(c) for c in ("part", "doc_id", "offset", "n_tokens")}
            yield pa.record_batch(columns | {name: pa.array([make(x) for x in ids], kind)})

    files = spark.read.schema(DOCS_SCHEMA).parquet(f"{folder}/docs")
    decoded = files.mapInArrow(decode, f"part int, doc_id long, offset long, n_tokens long, {field}")
    return decoded.join(starts(spark, folder), "part").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", name
    )
