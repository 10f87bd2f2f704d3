"""Chat formatting: collapse cumulative snapshots, then render.

A chat service often logs a conversation again after every turn, so one log is a prefix of another.
Each turn is hashed with its place, and the hashes are added up along the conversation: the running
sums identify every prefix. A conversation whose whole sum equals a proper prefix of another one is
dropped by an anti-join, as are later copies of the same conversation (the smallest id stays). What
is left is rendered with turn markers.

The running sums are made over range partitions (see ``ordered``), so that a very long conversation
spreads over tasks; common prefixes are reduced to one row each before the anti-join. Only rendering
brings the turns of one conversation together, since its text is one value. DataFrame functions only.

Rows without ``conv_id`` belong to no conversation and are left out. Repeated identical rows are one
turn. A null turn number comes first; turns with one number are ordered by role, then text. A null
role is rendered and compared as ``unknown``, a null text as empty. Markers inside a text are broken
up. Other columns are ignored. Prefix sums hold 4 x 32 bits of hash, so that two different prefixes
hardly ever meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.ordered import in_parts, running
from statloom.session import cut_lineage

LANES = ["lane_0", "lane_1", "lane_2", "lane_3"]


def turns(conversations: DataFrame) -> DataFrame:
    """The different turns with values for nulls: ``conv_id``, ``turn``, ``role``, ``text``."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.distinct()


def prefixes(told: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 1) and the lanes of the prefix hash, one row per turn."""
    light = told.select("conv_id", "turn", "role", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("a").asc(), F.col("b").asc()]
    parts = in_parts(light, ["conv_id"], order)
    placed = running(parts, ["conv_id"], order, {"place": F.lit(1).cast("long")})
    hashed = placed.select(
        "conv_id", "place", F.xxhash64("place", "role", "a", "b").alias("x"), F.xxhash64(F.lit(2), "place", "role", "a", "b").alias("y")
    )
    low = 0xFFFFFFFF
    lanes = [F.col(h).bitwiseAND(F.lit(low)) if k == 0 else F.shiftrightunsigned(h, 32) for h in "xy" for k in (0, 1)]
    hashed = hashed.select("conv_id", "place", *[lane.alias(f"own_{n}") for n, lane in zip(LANES, lanes)])
    by_place = [F.col("place").asc()]
    return running(in_parts(hashed, ["conv_id"], by_place), ["conv_id"], by_place, {n: F.col(f"own_{n}") for n in LANES}).select(
        "conv_id", "place", *LANES
    )


def maximal(told: DataFrame) -> DataFrame:
    """``conv_id`` and ``n_turns`` of the conversations that are no prefix and no later copy of another."""
    found = cut_lineage(prefixes(told))
    whole = found.groupBy("conv_id").agg(F.max(F.struct("place", *LANES)).alias("w")).select("conv_id", "w.*")
    first = whole.groupBy("place", *LANES).agg(F.min("conv_id").alias("conv_id"))
    lengths = whole.select(F.col("conv_id").alias("_conv"), F.col("place").alias("_n"))
    proper = found.join(lengths, F.col("conv_id") == F.col("_conv")).filter("place < _n")
    proper = proper.select("place", *LANES).distinct()
    return first.join(proper, ["place", *LANES], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def rendered(role: Column, text: Column) -> Column:
    """One turn between markers, with markers inside the text broken up."""
    safe = lambda x: F.replace(x, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), safe(role), F.lit("|>\n"), safe(text), F.lit("<|end|>\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, ``text`` of every maximal conversation."""
    told = turns(conversations)
    kept = maximal(told)
    row = F.struct("turn", "role", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), rendered(F.col("role"), F.col("text")).alias("line"))
    # the turns of one conversation: they make one value
    whole = told.join(kept, "conv_id").groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return whole.select("conv_id", "n_turns", F.array_join(F.col("turns.line"), "").alias("text"))
