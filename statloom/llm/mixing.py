"""Mixing sources to target weights by systematic sampling.

The sources share the words of all documents by weight; a source may give at most three times its own
words, and what it cannot take goes to the others by weight until none is above its limit. Within a
source every document is expected ``target / words`` times. The documents are laid end to end by size,
their expected copies added up, one random offset is added per source, and a document is taken once
for each whole number its stretch crosses. So a document is taken at most three times, copies are
within one of what is expected, and because neighbours have like sizes the words taken stay near
the target, within about the longest document.

Sizes are numbers of runs other than ASCII white space; null and empty texts have size 0. A null
source is a source of its own, last in order. Repeated rows and rows without id each have a place of
their own, after size and id by a hash of the text, then by the other columns. A source without words
has target 0 and is not taken. Other columns are passed on, whatever their names. Reruns agree: the
offset depends on the seed and the source alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import row_of
from statloom.llm.ordered import in_parts, running
from statloom.session import cut_lineage

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = 11
#: Rows alike in these are told apart by their other columns only.
KEY = ["doc_id", "source", "size", "hash"]
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source``, ``source_size`` with ``target``, the words that the mix should take from it.

    The limits are found by rounds of sums over the sources; only the sums reach the driver.
    """
    last = [F.col("source").asc_nulls_last()]
    parts = in_parts(sources, [], last)
    numbered = running(parts, [], last, {"_place": F.lit(1).cast("long")})
    cycle = F.array(*[F.lit(w) for w in weights])
    numbered = cut_lineage(
        numbered.withColumn("_weight", F.get(cycle, ((F.col("_place") - 1) % len(weights)).cast("int"))).drop("_place")
    )
    limit = F.lit(most) * F.col("source_size")
    level, capped = 0.0, -1
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    while True:
        above = F.col("_weight") * F.lit(level) > limit if capped >= 0 else F.lit(False)
        row = numbered.agg(
            F.count_if(above).alias("n"),
            F.sum(F.when(above, limit).otherwise(0)).alias("given"),
            F.sum(F.when(above, 0).otherwise(F.col("_weight"))).alias("weight"),
        ).first()
        if row["n"] == capped or not row["weight"]:
            break
        capped, level = row["n"], (total - row["given"]) / row["weight"]
    target = F.least(F.col("_weight") * F.lit(level), limit.cast("double"))
    return numbered.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 for each source."""
    name = F.concat(F.lit(f"{seed}|"), F.when(source.isNull(), "null").otherwise(F.concat(F.lit("s|"), source)))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 2**32


def _numbers(rows: Column) -> tuple[Column, Column]:
    """Two lists whose sums are the numbers from 1 to ``rows``; neither is long."""
    low = F.sequence(F.lit(1).cast("long"), F.least(rows, F.lit(1 << 16)))
    return F.sequence(F.lit(0).cast("long"), F.floor((rows - 1) / (1 << 16))), low


def copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """For rows of ``doc_id``, ``source``, ``size`` and, if there is one, ``hash`` of the text: how often the mix takes each.

    Returns doc_id, source, size, hash, source_size, target, rows (alike in the first four), number (from 1, among
    these), copies.
    """
    sized = sized if "hash" in sized.columns else sized.withColumn("hash", F.lit(0).cast("long"))
    keys = sized.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"))
    order = [F.col("size").asc(), F.col("doc_id").asc(), F.col("hash").asc()]
    parts = in_parts(keys, ["source"], order)
    sources = parts.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    goals = targets(sources, weights, most).withColumnRenamed("source", "_of")
    ranked = running(parts, ["source"], order, {"_end": F.col("rows")})
    out = ranked.join(goals, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    high, low = _numbers(F.col("rows"))
    out = out.withColumn("_high", F.explode(high)).withColumn("_low", F.explode(low))
    out = out.withColumn("number", F.col("_high") * (1 << 16) + F.col("_low")).filter("number <= rows")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u, place = offset(F.col("source"), seed), F.col("_end") - F.col("rows") + F.col("number")
    crossed = F.floor(rate * place + u) - F.floor(rate * (place - 1) + u)
    return out.withColumn("copies", crossed.cast("long")).drop("_end", "_high", "_low")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, columns unchanged."""
    rows = docs.select(row_of(docs), "doc_id", "source", size_of().alias("size"), F.xxhash64("text").alias("hash"))
    keys = cut_lineage(copies(rows.drop("row"), **options))

    def with_key(df: DataFrame, keyed: DataFrame, names: list[str], how: str) -> DataFrame:
        of = keyed.select(*[F.col(c).alias(f"_{c}") for c in [*names, "copies"]])
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return df.join(of, same, how)

    once = with_key(rows, keys.filter("rows = 1 AND copies > 0"), KEY, "inner")
    # rows alike in the key are numbered by what else they hold; written, their keys have a known size, and if
    # they are few they are sent to all tasks, so that whole rows are shuffled once, not again to find no match
    repeated = cut_lineage(keys.filter("rows > 1 AND number = 1").select(*KEY, "copies"))
    alike = with_key(rows, repeated, KEY, "left_semi")
    alike = alike.withColumns({"_else": F.xxhash64(F.to_json("row")), "_any": F.monotonically_increasing_id()})
    order = [F.col("_else").asc(), F.col("_any").asc()]
    numbered = running(in_parts(alike, KEY, order), KEY, order, {"number": F.lit(1).cast("long")})
    more = with_key(numbered, keys.filter("rows > 1 AND copies > 0"), [*KEY, "number"], "inner")
    taken = once.select("row", "_copies").unionByName(more.select("row", "_copies"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))
    return taken.select("row", copy.alias("_copy")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
