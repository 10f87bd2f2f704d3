"""Filter interaction audit by counting paths through the lattice of filter subsets.

A filter order is a path from the empty set of applied filters to the full one; applying filter f after
the set S is the edge S -> S + f. What the edge removes does not depend on how S was reached: the
documents that fail f and no filter in S. A forward pass counts the orders that reach each set, a
backward pass those that leave it; their product is the number of orders that use an edge, which is its
weight in the sum over all orders (the Shapley sum). Single orders read their steps from the same edges.

Documents are reduced to patterns, one bit for each failed filter, and counted per part, pattern and
label. Everything after that count has at most (parts x 2^filters x 4) rows, whatever the corpus.

Duplicates (filter E): the smallest id of each text comes from a grouped minimum, which is combined
before it is shuffled; documents meet it under (text, id), not under the text alone, so a group of copies
is spread over its ids. Texts are compared by their SHA-256.

Null texts read as empty, so all empty texts are copies of each other. A document without an id has no
smaller id and is no smaller id: it passes E and has no label. Documents that share an id have equal claim
to be the first of their text, and share the labels of that id; a label counts if any row of ``labels``
for the id has it. A null part reads as the empty string. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.session import cut_lineage

#: Filters that may be audited together: the orders are listed, so their number must stay small.
MOST_FILTERS = 6
SPACE = r"[\x20\x09-\x0D]+"


# --- the lattice ---------------------------------------------------------------------------------------


def reaching(n: int) -> list[int]:
    """For each set of filters, as bits, the number of orders in which it gets applied first."""
    found = [1] + [0] * (2**n - 1)
    for state in range(1, 2**n):
        found[state] = sum(found[state ^ 1 << f] for f in range(n) if state >> f & 1)
    return found


def leaving(n: int) -> list[int]:
    """For each set of filters the number of orders of the others."""
    found = [0] * (2**n - 1) + [1]
    for state in reversed(range(2**n - 1)):
        found[state] = sum(found[state | 1 << f] for f in range(n) if not state >> f & 1)
    return found


def edges(n: int) -> list[tuple[int, int, int]]:
    """(set before, filter, orders that use the edge)."""
    into, out = reaching(n), leaving(n)
    return [
        (state, f, into[state] * out[state | 1 << f])
        for state in range(2**n)
        for f in range(n)
        if not state >> f & 1
    ]


# --- documents -----------------------------------------------------------------------------------------


def text_conditions(text: str = "text") -> dict[str, Column]:
    """The failure conditions that a text alone decides."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    n_words, n_distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    return {
        "A": n_words < 200,
        "B": 100 * n_distinct < 50 * n_words,
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")).cast("long") > 3 * F.length(t).cast("long"),
        "D": t.rlike(r"[#$%&*|]"),
    }


def bits(conditions: Sequence[Column]) -> Column:
    """Failed conditions as bits, the first the lowest; a null condition is not failed."""
    return sum(
        (F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(conditions)), F.lit(0)
    ).cast("int")


def patterns(
    docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], part: Column, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Count documents: part, fails (bits; the bit after the conditions marks later copies), good, toxic, n."""
    copy = 1 << len(conditions)
    read = docs.select(
        F.col(key).alias("id"),
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        bits(list(conditions.values())).alias("fails"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("same"),
    )
    # a short row for each document is written, so that the texts are read once
    rows = cut_lineage(read.groupBy("id", "part", "fails", "same").agg(F.count("*").alias("n")))
    known = rows.where(F.col("id").isNotNull())
    first = known.groupBy("same").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    told = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    judged = (
        known.join(first, ["same", "id"], "left")
        .join(told, "id", "left")
        .select(
            "part",
            (F.col("fails") + F.when(F.col("first"), 0).otherwise(copy)).alias("fails"),
            F.coalesce("good", F.lit(False)).alias("good"),
            F.coalesce("toxic", F.lit(False)).alias("toxic"),
            "n",
        )
    )
    nameless = rows.where(F.col("id").isNull()).select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return judged.unionByName(nameless).groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


# --- the audit -----------------------------------------------------------------------------------------


def walk(counted: DataFrame, n_filters: int) -> DataFrame:
    """What every edge of the lattice does in every part, from the counts of ``patterns``.

    One row per part and edge: state, filter, orders, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost. Each count meets the constant list of edges inside its row.
    """
    listed = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("orders")) for s, f, w in edges(n_filters)])
    met = counted.select("part", "fails", "good", "toxic", "n", F.inline(listed))
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    failing = F.col("fails").bitwiseAND(bit) != 0
    before = F.col("fails").bitwiseAND(F.col("state")) != 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return met.groupBy("part", "state", "filter", "orders").agg(
        total(~before & ~failing).alias("kept"),
        total(~before & failing).alias("removed"),
        total(before & failing).alias("redundant"),
        total(F.col("fails") == bit).alias("unique_fails"),
        total(~before & failing & F.col("good")).alias("good_lost"),
        total(~before & failing & F.col("toxic")).alias("toxic_lost"),
    )


def shapley(walked: DataFrame) -> DataFrame:
    """Per part and filter the removals summed over all orders."""
    return walked.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))


def steps(walked: DataFrame, names: str) -> DataFrame:
    """Every step of every order of ``names``, read from the edges: one row per part, filter_order and step."""
    spark = walked.sparkSession
    listed = [
        ("".join(order), k + 1, sum(1 << names.index(f) for f in order[:k]), names.index(f))
        for order in permutations(names)
        for k, f in enumerate(order)
    ]
    orders = spark.createDataFrame(listed, "filter_order string, step int, state int, filter int")
    sums = shapley(walked)
    return walked.drop("orders").join(sums, ["part", "filter"]).join(orders, ["state", "filter"]).drop("state", "filter")


def audit(
    docs: DataFrame,
    labels: DataFrame,
    conditions: dict[str, Column] | None = None,
    part: Column | None = None,
    copies: str = "E",
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Audit all orders of one-letter filters: ``conditions`` (column: the document fails) and later ``copies``.

    Only the columns that are asked for are read, so others may have any names.
    """
    conditions = text_conditions(text) if conditions is None else conditions
    part = F.col("lang") if part is None else part
    names = "".join(conditions) + copies
    if len(names) > MOST_FILTERS or len(set(names)) != len(conditions) + 1:
        raise ValueError(f"at most {MOST_FILTERS} filters, each named by a letter of its own: {names}")
    counted = cut_lineage(patterns(docs, labels, conditions, part, key, text))
    return steps(walk(counted, len(names)), names)
