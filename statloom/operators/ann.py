"""Approximate k-nearest-neighbour join: random-projection buckets with multi-probe.

Every table of buckets projects the features on a few random directions and cuts each direction into
slabs. Slabs follow the logistic curve through the mean and spread of the segment's projections, so that
they hold about equally many rows where rows are dense; their number grows with the segment and keeps a
bucket at about ``bucket_rows`` candidates. A subject visits, in every table, its own bucket and the
neighbouring ones whose borders are closest to it, but none whose border is farther than the k-th candidate
of its first bucket. Distances to visited candidates are exact.

The share of true neighbours that is found grows with ``tables`` and ``probes``; ``recall`` measures it.
Every subject has ``k`` matches if its segment has: those whose buckets hold fewer are searched exactly.
A bucket of any size (repeated points fall into one) is met in blocks, never in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.hotgroups import _match
from statloom.operators.knn import BLOCK_ROWS, SLACK, closest_in_cells, nearest
from statloom.operators.project import top_per_group
from statloom.session import cut_lineage

#: The logistic curve with this slope is close to the normal distribution's.
SLOPE = 1.702
MOST_SLABS = 1 << 15


def _projections(features: Sequence[str], tables: int, directions: int, seed: int) -> list[list[Column]]:
    """For each table its projections on orthogonal unit directions."""
    rng = np.random.default_rng(seed)
    n = len(features)
    out = []
    for _ in range(tables):
        axes = np.linalg.qr(rng.normal(size=(n, n)))[0][:, :directions]
        out.append([reduce(lambda a, b: a + b, [F.col(f) * float(w) for f, w in zip(features, axis)]) for axis in axes.T])
    return out


def _bucket(table: int, slabs: Sequence[Column]) -> Column:
    """Table and slab numbers packed into one number."""
    return reduce(lambda a, s: a * (2 * MOST_SLABS) + (s + 1), slabs, F.lit(table).cast("bigint"))


def approximate_nearest(
    subjects: DataFrame,
    candidates: DataFrame,
    segment: Sequence[str],
    features: Sequence[str],
    k: int,
    subject: str,
    candidate: str,
    tables: int = 3,
    directions: int = 2,
    probes: int = 4,
    bucket_rows: int = 1024,
    block_rows: int = BLOCK_ROWS,
    seed: int = 29,
) -> DataFrame:
    """Like ``knn.nearest``, and with its columns, but a neighbour may be missed for a farther one.

    Rows with a missing segment or feature take no part. At most three directions a table.
    """
    segment, features = list(segment), list(features)
    directions = min(directions, len(features), 3)
    match = f"match_{candidate}" if candidate == subject else candidate
    numbers = [F.col(f).cast("double").alias(f) for f in features]
    pool = cut_lineage(candidates.select(*segment, F.col(candidate).alias("_cid"), *numbers).dropna())
    asking = cut_lineage(subjects.select(*segment, F.col(subject).alias("_sid"), *numbers).dropna())
    axes = _projections(features, tables, directions, seed)
    flat = [p for table in axes for p in table]

    slabs = F.ceil(F.pow(F.count(F.lit(1)) / bucket_rows, F.lit(1.0 / directions)))
    frame = pool.groupBy(*segment).agg(
        F.greatest(F.lit(1), F.least(slabs, F.lit(MOST_SLABS))).cast("bigint").alias("_slabs"),
        F.array(*[F.avg(p) for p in flat]).alias("_mean"),
        F.array(*[F.stddev_pop(p) for p in flat]).alias("_spread"),
    )
    frame = cut_lineage(frame.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(segment)], "_slabs", "_mean", "_spread"))

    def with_places(rows: DataFrame) -> DataFrame:
        """Add the place on every direction, in spreads from the mean and in slabs: its whole part is the slab."""
        met = rows.join(frame, _match(segment)).withColumn(
            "_z", F.array(*[F.coalesce(F.try_divide(p - F.get("_mean", F.lit(i)), F.get("_spread", F.lit(i))), F.lit(0.0)) for i, p in enumerate(flat)])
        )
        # the last slab is closed
        placed = F.transform("_z", lambda z: F.least(F.col("_slabs") / (1 + F.exp(-SLOPE * z)), F.col("_slabs") - 1e-9))
        return met.withColumn("_place", placed).drop("_mean", *[f"_key{i}" for i in range(len(segment))])

    place = lambda t, d: F.get("_place", F.lit(t * directions + d))
    slab = lambda t, d: F.floor(place(t, d))
    homes = F.array(*[_bucket(t, [slab(t, d) for d in range(directions)]) for t in range(tables)])
    placed = cut_lineage(with_places(pool).select(*segment, "_cid", *features, F.explode(homes).alias("_cell")))

    def away(t: int, d: int, step: int) -> Column:
        """Distance along a direction to the border with the next slab; none of its candidates is closer."""
        border = slab(t, d) + (1 if step > 0 else 0)
        z = -F.log(F.try_divide(F.col("_slabs"), border) - 1) / SLOPE
        gap = F.abs(F.get("_z", F.lit(t * directions + d)) - z) * F.get("_spread", F.lit(t * directions + d))
        return F.coalesce(gap, F.lit(0.0))

    def visited(t: int) -> Column:
        """The buckets of a table whose borders are closest, and how far these are."""
        options = []
        for steps in product((0, -1, 1), repeat=directions):
            gaps = [
                F.lit(0.0) if s == 0 else (place(t, d) - slab(t, d) if s < 0 else slab(t, d) + 1 - place(t, d))
                for d, s in enumerate(steps)
            ]
            inside = [(slab(t, d) + s >= 0) & (slab(t, d) + s < F.col("_slabs")) for d, s in enumerate(steps)]
            cell = _bucket(t, [slab(t, d) + s for d, s in enumerate(steps)])
            far = reduce(lambda a, b: a + b, [F.pow(away(t, d, s), F.lit(2)) if s else F.lit(0.0) for d, s in enumerate(steps)])
            option = F.struct(reduce(lambda a, b: a + b, [g * g for g in gaps]).alias("gap"), cell.alias("_cell"), F.sqrt(far).alias("_away"))
            options.append(F.when(reduce(lambda a, b: a & b, inside), option))
        return F.slice(F.array_sort(F.array_compact(F.array(*options))), 1, probes)

    row, cells = [*segment, "_sid"], [*segment, "_cell"]

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy(*row, "_cid").agg(F.min("distance").alias("distance"))
        return cut_lineage(top_per_group(once, row, ["distance", "_cid"], k, rank="position"))

    # the k-th distance in a subject's first bucket bounds which others it visits and what they return
    every = F.posexplode(F.concat(*[visited(t) for t in range(tables)])).alias("_turn", "_to")
    visits = with_places(asking).select(*row, *features, every).select(*row, *features, "_turn", "_to._cell", "_to._away")
    visits = cut_lineage(visits)
    first = visits.where("_turn = 0").select(*cells, "_sid", *features)
    best = ranked(closest_in_cells(first, placed, segment, cells, features, k, block_rows))
    reach = best.where(F.col("position") == k).select(*row, F.col("distance").alias("_radius"))
    later = visits.where("_turn > 0").join(reach, row, "left").fillna({"_radius": float("inf")})
    later = later.where(F.col("_away") <= F.col("_radius") * (1 + SLACK) + SLACK).drop("_turn", "_away")
    more = closest_in_cells(cut_lineage(later), placed, segment, cells, features, k, block_rows, within="_radius")
    best = ranked(best.drop("position").unionByName(more))

    # subjects with too few candidates in reach
    full = best.where(F.col("position") == k).select(*segment, "_sid")
    short = asking.join(full, [*[asking[c].eqNullSafe(full[c]) for c in segment], asking["_sid"] == full["_sid"]], "left_anti")
    short = cut_lineage(short)
    named = [*segment, F.col("_sid").alias(subject), "position", F.col("_cid").alias(match), "distance"]
    if short.limit(1).count() == 0:
        return best.select(*named)
    whole = best.join(full, [*[best[c].eqNullSafe(full[c]) for c in segment], best["_sid"] == full["_sid"]], "left_semi")
    rest = nearest(short, pool, segment, features, k, "_sid", "_cid", block_rows=block_rows)
    return whole.select(*named).unionByName(
        rest.select(*segment, F.col("_sid").alias(subject), "position", F.col("_cid").alias(match), "distance")
    )


def recall(found: DataFrame, exact: DataFrame, by: Sequence[str], subject: str) -> DataFrame:
    """Per ``by`` the number of exact matches and the share of them that is matched at least as closely."""
    key = [*by, subject, "position"]
    seen = found.select(*key, F.col("distance").alias("_found"))
    met = exact.select(*key, "distance").join(seen, key, "left")
    hit = F.coalesce(F.col("_found") <= F.col("distance") * (1 + 1e-12), F.lit(False))
    return met.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("recall"))
