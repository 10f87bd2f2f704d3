"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case A-Z to lower case, every other byte unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Text handled at a time inside a Python task, so that memory does not depend on the batch size.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of each text; null reads as empty."""
    return [b"" if v is None else v for v in batch.column(column).cast(pa.binary()).to_pylist()]


def lowered(text: bytes) -> bytes:
    return text.translate(LOWER)


def id_remainder(name: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % divisor


def row_of(docs: DataFrame, keep: Sequence[str] | None = None) -> Column:
    """The columns ``keep`` of ``docs`` (all) as one struct ``row``, where no name clashes with a result's."""
    return F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row")


def fresh(docs: DataFrame, name: str) -> str:
    """A column name made from ``name`` that ``docs`` does not have (names differ in more than case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
