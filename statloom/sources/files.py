"""Readers with declared schemas, and writers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.scalar import epoch_ms
from statloom.operators.project import nan_to_null

# Positions of the fields in a landed price bar.
BAR_FIELDS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "num_trades", "taker_base_volume", "taker_quote_volume",
]


def load_table(
    spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None, nan_is_missing: bool = False
) -> DataFrame:
    """One parquet table of a folder; the column list is pruned at the scan.

    ``nan_is_missing`` is for files written by tools that store missing numbers as NaN. It is off by
    default because rewriting a column keeps filters on it from reaching the scan.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return nan_to_null(df) if nan_is_missing else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)
    return nan_to_null(df.select(*columns) if columns else df)


def read_season_json(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Landed JSON records of all seasons as one table; a ``season=...`` folder level prunes."""
    return nan_to_null(spark.read.schema(schema).json(folder))


def read_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Landed price bars, one JSON array per line under ``symbol=...`` folders, as named columns."""
    cells = F.from_json("value", T.ArrayType(T.StringType()))
    rows = spark.read.option("basePath", folder).text(folder).select("symbol", cells.alias("_bar"))
    named = {f: F.get("_bar", F.lit(i)) for i, f in enumerate(BAR_FIELDS)}
    times = ("open_time", "close_time")
    typed = {f: epoch_ms(c) if f in times else c.cast("bigint" if f == "num_trades" else "double") for f, c in named.items()}
    return nan_to_null(rows.select("symbol", *[c.alias(f) for f, c in typed.items()]).withColumn("ts", F.col("open_time")))


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").option("header", True).partitionBy(*partition_by).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_laid_out(df: DataFrame, entity: Sequence[str], order: Sequence[str], buckets: int, path: str, name: str | None = None) -> DataFrame:
    """Write a table dealt into buckets by entity and sorted by entity and order, and return it as read back.

    Windows over the entity, and joins with a table laid out by the same keys into as many buckets, then
    read their rows where they lie, without a shuffle. Rows are dealt before writing, so a bucket is one
    file; ``name`` registers the table under a name of its own.
    """
    spark = df.sparkSession
    name = name or f"laid_out_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *entity)
    dealt.write.bucketBy(buckets, *entity).sortBy(*entity, *order).option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)
