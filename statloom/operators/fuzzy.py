"""Name matching by Jaro distance without comparing all pairs.

Jaro similarity s needs m matching characters with m/|a| + m/|b| >= 3s - 1, so two matching names
share that many characters, counted with repetition. Treating (letter, occurrence) as set elements
and sorting them rarest first, two sets with a large overlap must already share a few elements among
their first ones. Names are joined on triples of those first elements, so only pairs that could
match are ever formed, and none that does match is missed.

Any order of the elements is right as long as both sides use it; the rarest of the two lists come first,
as they are counted there, so letters that most names share end up in no key. A key that is frequent
nevertheless is met in blocks: its names are dealt into pieces on either side, and every piece of one side
meets every piece of the other as a key of its own.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.text import jaro_similarity
from statloom.operators.joins import lookup
from statloom.session import cut_lineage

EPS = 1e-9
#: Elements (letter and occurrence) whose frequency is known; all others count as rarest.
KNOWN = 200
#: Names of one key that one block holds of either side.
BLOCK_CONF = "statloom.nameBlockRows"
BLOCK = 2_000


def _least_overlap(n: float, g: float) -> int:
    shortest = math.ceil((g - 1) * n - EPS)
    return math.ceil(g * n * shortest / (n + shortest) - EPS)


def _key_size(g: float, longest: int = 256) -> int:
    """Elements per join key: 3 where every pair of names that may match can be keyed alike."""
    size = {n: min(3, _least_overlap(n, g)) for n in range(1, longest)}
    for n in range(1, longest):
        for other in range(n, min(longest, math.floor(n / (g - 1) + EPS) + 1)):
            if size[n] != size[other]:
                return 1
    return 3


def _occurrences(name: Column) -> Column:
    """Distinct elements 'letter occurrence' of a name."""
    letters = F.filter(F.split(name, ""), lambda ch: ch != "")
    seen = lambda ch, i: F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == ch))
    return F.transform(letters, lambda ch, i: F.concat_ws(" ", ch, seen(ch, i).cast("string")))


def _common_first(names: DataFrame) -> list[str]:
    """The ``KNOWN`` most frequent elements, most frequent first."""
    counts = names.select(F.explode("_el").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    return [r["x"] for r in counts.orderBy(F.desc("n"), "x").limit(KNOWN).collect()]


def _rare_first(elements: Column, common: Sequence[str]) -> Column:
    """Elements as 'rank element', those that are rarest in the lists first."""
    # one constant; a letter that is the separator itself only changes the order, on both sides alike
    known = F.split(F.lit("\x00".join(reversed(common))), "\x00")
    ranked = lambda x: F.concat_ws(" ", F.lpad(F.array_position(known, x).cast("string"), 4, "0"), x)
    return F.array_sort(F.transform(elements, ranked))


def _keys(elements: Column, g: float, size: int) -> Column:
    n = F.size(elements)
    shortest = F.ceil((g - 1) * n - EPS)
    overlap = F.ceil(g * n * shortest / (n + shortest) - EPS)
    width = F.least(overlap, F.lit(size))
    head = F.slice(elements, F.lit(1), (n - overlap + width).cast("int"))
    rest = lambda start: F.slice(head, start, F.size(head))
    if size == 1:
        return F.transform(head, lambda x: F.xxhash64(x))
    triples = F.flatten(
        F.transform(
            head,
            lambda x, i: F.flatten(
                F.transform(rest(i + 2), lambda y, j: F.transform(rest(i + j + 3), lambda z: F.xxhash64(x, y, z)))
            ),
        )
    )
    # names of one or two letters must agree entirely
    return F.when(width < size, F.array(F.xxhash64(F.concat_ws("|", elements)))).otherwise(triples)


def _in_blocks(l: DataFrame, r: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Add pieces ``_lp`` and ``_rp`` to the key: frequent keys are dealt into several on either side.

    The table of frequent keys has at most (rows / block) rows, and is joined by its size.
    """
    block = int(l.sparkSession.conf.get(BLOCK_CONF, str(BLOCK)))
    count = lambda df, n: df.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    both = count(l, "_nl").join(count(r, "_nr"), list(key)).filter((F.col("_nl") > block) | (F.col("_nr") > block))
    pieces = lambda n: F.ceil(F.col(n) / block).cast("int")
    if both.isEmpty():
        one = {"_lp": F.lit(0), "_rp": F.lit(0)}
        return l.withColumns(one), r.withColumns(one)
    heavy = cut_lineage(both.select(*key, pieces("_nl").alias("_ls"), pieces("_nr").alias("_rs")))

    def dealt(df: DataFrame, name: str, own: str, other: str, own_n: str, other_n: str) -> DataFrame:
        n, m = F.coalesce(own_n, F.lit(1)), F.coalesce(other_n, F.lit(1))
        out = df.join(heavy, list(key), "left").withColumn(own, F.pmod(F.xxhash64(name), n).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), m - 1))).drop("_ls", "_rs")

    return dealt(l, "name_l", "_lp", "_rp", "_ls", "_rs"), dealt(r, "name_r", "_rp", "_lp", "_rs", "_ls")


def similar_pairs(
    left: DataFrame,
    right: DataFrame,
    name: tuple[str, str],
    exact: Mapping[str, str] | None = None,
    max_distance: float = 0.1,
) -> DataFrame:
    """Distinct (exact keys, ``name_l``, ``name_r``) with Jaro distance <= ``max_distance``.

    ``exact`` maps left to right columns that must be equal. Equal seasons such as '2016-17' belong
    here: two different ones are never within 0.1 of each other.
    """
    g = 3 * (1 - max_distance) - 1
    if g <= 1:
        raise ValueError("max_distance must be below 1/3")
    exact = dict(exact or {})
    size = _key_size(g)

    e = [f"_e{i}" for i in range(len(exact))]

    def listed(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
        names = df.select(*[F.col(c).alias(f"_e{i}") for i, c in enumerate(keys)], F.col(column).alias("_name"))
        return names.dropna().filter(F.length("_name") > 0)

    lists = listed(left, list(exact.keys()), name[0]), listed(right, list(exact.values()), name[1])
    every = lists[0].select("_name").unionByName(lists[1].select("_name")).distinct()
    common = _common_first(every.select(_occurrences(F.col("_name")).alias("_el")))

    def side(names: DataFrame, tag: str) -> DataFrame:
        keyed = names.distinct().withColumn("_el", _rare_first(_occurrences(F.col("_name")), common))
        keyed = keyed.withColumn("_key", F.explode(F.array_distinct(_keys(F.col("_el"), g, size))))
        return cut_lineage(keyed.withColumnsRenamed({"_name": f"name_{tag}", "_el": f"_el_{tag}"}))

    l, r = _in_blocks(side(lists[0], "l"), side(lists[1], "r"), [*e, "_key"])
    nl, nr = F.size("_el_l"), F.size("_el_r")
    shared = F.size(F.array_intersect("_el_l", "_el_r"))
    pairs = (
        l.join(r, [*e, "_key", "_lp", "_rp"])
        .filter((F.least(nl, nr) >= (g - 1) * F.greatest(nl, nr) - EPS) & (shared * (nl + nr) >= g * nl * nr - EPS))
        .select(*e, "name_l", "name_r")
        .distinct()
    )
    checked = pairs.withColumn("distance", 1 - jaro_similarity("name_l", "name_r"))
    return checked.filter(F.col("distance") <= max_distance + 1e-12)


def fuzzy_left_join(
    left: DataFrame,
    right: DataFrame,
    name: tuple[str, str],
    exact: Mapping[str, str] | None = None,
    max_distance: float = 0.1,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Left join on near-equal names; a left row with several near names repeats, one with none
    keeps NULLs. Adds the matched right name as ``matched_name`` and the ``distance``."""
    exact = dict(exact or {})
    pairs = similar_pairs(left, right, name, exact, max_distance)
    keep = list(columns) if columns is not None else [c for c in right.columns if c not in exact.values()]
    e_right = {f"_e{i}": c for i, c in enumerate(exact.values())}
    info = right.select(*dict.fromkeys([*exact.values(), name[1]]), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(keep)])
    matched = lookup(pairs, info, {**e_right, "name_r": name[1]}, [f"_v{i}" for i in range(len(keep))], "inner")
    matched = matched.select(
        *[F.col(f"_e{i}") for i in range(len(exact))], "name_l", F.col("name_r").alias("matched_name"), "distance",
        *[F.col(f"_v{i}").alias(c) for i, c in enumerate(keep)],
    )
    return lookup(
        left, matched, {**{c: f"_e{i}" for i, c in enumerate(exact)}, name[0]: "name_l"}, ["matched_name", "distance", *keep]
    )
