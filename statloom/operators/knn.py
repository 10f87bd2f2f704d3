"""Exact k-nearest-neighbour join inside segments.

Comparing every subject with every candidate of its segment grows with the square of the segment, so
the candidates are dealt into cells of about ``min_cell_rows`` rows by cuts at medians, along the feature
that varies most in what is cut. The cuts are chosen on a bounded sample, which decides only how quick the
search is; the box around a cell's rows is taken from all of them. A subject is compared with its own cell
first. The distance to the k-th candidate found there bounds its search: it visits only cells whose box
is no farther. So the cells that a subject visits do not multiply with the table. Cells and visits are cut
into blocks of bounded size; inside a block the candidates are cut again, down to ``LEAF_ROWS``, and searched the same
way. A final top-k merges what the blocks return. The result is exact for any
choice of cuts. The driver holds the cuts and boxes, at most ``SAMPLE_ROWS`` / ``LEAST_SAMPLE`` of them. Of
candidates at one point only the first k by id can be neighbours, and only they are dealt out. Tables that
are read several times are materialised in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.operators.project import top_per_group
from statloom.session import cut_lineage

BLOCK_ROWS = 32_768
MIN_CELL_ROWS = 16_384
#: Candidates of a block that are compared at once.
LEAF_ROWS = 256
#: Rows on which the cuts are chosen, and the fewest of them that a cell holds.
SAMPLE_ROWS = 131_072
LEAST_SAMPLE = 8
# pairs of one chunk of a block
CHUNK_PAIRS = 1 << 18
# pairs that a block holds before it drops all but the closest
HELD_PAIRS = 1 << 20
# widening of the search radius that absorbs rounding
SLACK = 1e-9


class Cells:
    """Cuts of all segments: the children of a node are ``child`` (x <= cut) and the next one, a leaf has axis -1.

    Node 0 is the only cell of every segment that is not cut.
    """

    def __init__(self) -> None:
        self.axis, self.cut, self.child = [-1], [0.0], [0]

    def grow(self, points: np.ndarray, least: int) -> int | None:
        """Cut a segment until a side would have fewer than ``least`` of the points; its root, or None if it is not cut."""
        root = len(self.axis)
        self._add()
        todo = [(root, points)]
        while todo:
            node, x = todo.pop()
            for axis in np.argsort(-x.std(axis=0), kind="stable") if len(x) >= 2 * least else ():
                values = np.sort(x[:, axis])
                # the last place of the lower side: at the middle, or where equal values around it end or begin
                cut = values[len(x) // 2 - 1]
                low = int(np.searchsorted(values, cut, side="right"))
                if len(x) - low < least:
                    low = int(np.searchsorted(values, cut, side="left"))
                if least <= low <= len(x) - least:
                    self.axis[node], self.cut[node], self.child[node] = int(axis), float(values[low - 1]), len(self.axis)
                    lower = x[:, axis] <= values[low - 1]
                    for part in (x[lower], x[~lower]):
                        todo.append((len(self.axis), part))
                        self._add()
                    break
        if self.axis[root] < 0:
            self.axis.pop(), self.cut.pop(), self.child.pop()
            return None
        return root

    def _add(self) -> None:
        self.axis.append(-1), self.cut.append(0.0), self.child.append(0)

    def freeze(self) -> None:
        self.axis, self.cut, self.child = np.array(self.axis), np.array(self.cut), np.array(self.child)

    def place(self, root: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The cell of every row of ``x``."""
        at, rows = root.copy(), np.arange(len(x))
        while len(rows):
            rows = rows[self.axis[at[rows]] >= 0]
            node = at[rows]
            at[rows] = self.child[node] + (x[rows, self.axis[node]] > self.cut[node])
        return at

    def bound(self, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Take the boxes of the cells; a node's box holds those of its children."""
        self.low = np.full((len(self.axis), low.shape[1]), np.inf)
        self.high = -self.low
        self.low[cell], self.high[cell] = low, high
        for node in range(len(self.axis) - 1, 0, -1):
            if self.axis[node] >= 0:
                sides = slice(self.child[node], self.child[node] + 2)
                self.low[node], self.high[node] = self.low[sides].min(axis=0), self.high[sides].max(axis=0)

    def within(self, root: np.ndarray, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for the cells whose box is no farther from a row than its radius."""
        limit = radius * (1 + SLACK) + SLACK
        todo = [(int(r), np.flatnonzero(root == r)) for r in np.unique(root)]
        found: list[tuple[np.ndarray, int]] = []
        while todo:
            node, rows = todo.pop()
            gap = np.maximum(np.maximum(self.low[node] - x[rows], x[rows] - self.high[node]), 0.0)
            rows = rows[~(np.sqrt((gap**2).sum(axis=1)) > limit[rows])]
            if not len(rows):
                continue
            if self.axis[node] < 0:
                found.append((rows, node))
            else:
                todo += [(int(self.child[node]), rows), (int(self.child[node]) + 1, rows)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([r for r, _ in found]), np.concatenate([np.full(len(r), n) for r, n in found])


def _first(found: list[tuple[np.ndarray, ...]], take: int) -> tuple[np.ndarray, ...]:
    """The ``take`` first of (row, column, distance) for every row, by distance and column."""
    row, col, gap = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((col, gap, row))
    row, col, gap = row[order], col[order], gap[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row, side="left") < take
    return row[kept], col[kept], gap[kept]


def closest_points(x: np.ndarray, at: np.ndarray, k: int, radius: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, column, distance): of every row of ``x`` the ``k`` closest rows of ``at``, the first of equally close ones.

    With ``radius`` only those that are no farther than it.
    """
    take, cells = min(k, len(at)), Cells()
    root = cells.grow(at[np.isfinite(at).all(axis=1)], max(LEAF_ROWS // 2, take)) or 0
    cells.freeze()
    leaf = cells.place(np.full(len(at), root), at)
    order = np.argsort(leaf, kind="stable")
    leaves, starts = np.unique(leaf[order], return_index=True)
    members = dict(zip(leaves.tolist(), np.split(order, starts[1:])))
    cells.bound(leaves, np.minimum.reduceat(at[order], starts), np.maximum.reduceat(at[order], starts))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def meet(node: int, rows: np.ndarray, most: np.ndarray | None) -> None:
        """Compare rows with a leaf; without ``most`` its own k-th candidate is a row's bound, and is noted in ``reach``."""
        nonlocal found
        cols = members[node]
        step = max(1, CHUNK_PAIRS // len(cols))
        for q in (rows[i : i + step] for i in range(0, len(rows), step)):
            squares = np.zeros((len(q), len(cols)))
            for f in range(x.shape[1]):
                squares += (x[q, f][:, None] - at[cols, f]) ** 2
            if most is None:
                reach[q] = np.partition(squares, take - 1, axis=1)[:, take - 1]
            # a little more, because unequal squares may have equal roots; what is no number stays
            row, col = np.nonzero(~(squares > (reach if most is None else most)[q, None] * (1 + 1e-14)))
            found.append(_first([(q[row], cols[col], np.sqrt(squares[row, col]))], take))
        if sum(len(f[0]) for f in found) > HELD_PAIRS:
            found = [_first(found, take)]

    def by_node(node: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(node, kind="stable")
        places, first = np.unique(node[order], return_index=True)
        return zip(places.tolist(), np.split(rows[order], first[1:]))

    home = np.full(len(x), -1)
    if radius is None:
        reach = np.full(len(x), np.inf)
        home = cells.place(np.full(len(x), root), x)
        for node, rows in by_node(home, np.arange(len(x))):
            meet(node, rows, None)
    else:
        reach = radius**2
    row, node = cells.within(np.full(len(x), root), x, np.sqrt(reach))
    other = node != home[row]
    for n, rows in by_node(node[other], row[other]):
        meet(n, rows, reach)
    return _first(found, take)


def _cut_segments(pool: DataFrame, segment: Sequence[str], features: Sequence[str], k: int, cell_rows: int, pivots: int | None) -> tuple[Cells, DataFrame | None]:
    """The cuts, chosen on a sample of the candidates, and the cut segments with their root node."""
    n = pool.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    drawn = F.abs(F.xxhash64("_cid", *features) / float(2**63)) < share if share < 1 else F.lit(True)
    sample: dict[tuple, list[tuple]] = {}
    for row in pool.where(drawn).select(*segment, *features).limit(2 * SAMPLE_ROWS).collect():
        sample.setdefault(tuple(row[: len(segment)]), []).append(tuple(row[len(segment) :]))
    least = max(LEAST_SAMPLE, k, round(cell_rows * share / 2))
    cells, roots = Cells(), []
    for key, rows in sample.items():
        points = np.array(rows, float)
        root = cells.grow(points[np.isfinite(points).all(axis=1)], max(least, -(-len(points) // pivots)) if pivots else least)
        if root is not None:
            roots.append((*key, root))
    cells.freeze()
    if not roots:
        return cells, None
    schema = T.StructType([*(T.StructField(c, pool.schema[c].dataType) for c in segment), T.StructField("_root", T.IntegerType())])
    return cells, pool.sparkSession.createDataFrame(roots, schema)


def nearest(
    subjects: DataFrame,
    candidates: DataFrame,
    segment: Sequence[str],
    features: Sequence[str],
    k: int,
    subject: str,
    candidate: str,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
    min_cell_rows: int = MIN_CELL_ROWS,
) -> DataFrame:
    """The ``k`` closest candidates of every subject by Euclidean distance within its segment.

    Returns segment columns, ``subject``, ``position`` (1 = closest), ``candidate`` (both under the
    names given, prefixed ``match_`` if equal) and ``distance``. Equal distances are ordered by
    candidate id. Rows with a missing feature take no part. ``pivots`` bounds the cells of a segment.
    """
    segment, features = list(segment), list(features)
    match = f"match_{candidate}" if candidate == subject else candidate
    numbers = [F.col(f).cast("double").alias(f) for f in features]
    pool = candidates.select(*segment, F.col(candidate).alias("_cid"), *numbers).dropna()
    pool = cut_lineage(top_per_group(pool, [*segment, *features], ["_cid"], k))
    asking = subjects.select(*segment, F.col(subject).alias("_sid"), *numbers).dropna()

    cuts, roots = _cut_segments(pool, segment, features, k, min_cell_rows, pivots)
    schema = lambda df, *more: T.StructType([*df.schema.fields, *(T.StructField(c, T.IntegerType()) for c in more)])

    def points(rows: pd.DataFrame) -> np.ndarray:
        return rows[features].to_numpy(float)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(_cell=cuts.place(rows["_root"].to_numpy(np.int64), points(rows)).astype(np.int32))

    def with_cell(df: DataFrame) -> DataFrame:
        if roots is None:
            return df.withColumn("_root", F.lit(0)).withColumn("_cell", F.lit(0))
        # the directory is bounded by the sample
        rooted = df.join(F.broadcast(roots), segment, "left").fillna(0, ["_root"])
        return rooted.mapInPandas(place, schema(rooted, "_cell"))

    cells = [*segment, "_cell"]
    placed = cut_lineage(with_cell(pool).drop("_root"))
    asking = cut_lineage(with_cell(asking))
    own = closest_in_cells(asking.drop("_root"), placed, segment, cells, features, k, block_rows)
    best = top_per_group(own, [*segment, "_sid"], ["distance", "_cid"], k, rank="position")
    if roots is not None:
        best = cut_lineage(best)
        reach = best.where(F.col("position") == k).select(*segment, "_sid", F.col("distance").alias("_radius"))
        lows, highs = ([f"_{side}{i}" for i in range(len(features))] for side in ("low", "high"))
        sides = [g(f).alias(n) for g, names in ((F.min, lows), (F.max, highs)) for f, n in zip(features, names)]
        boxes = placed.where("_cell > 0").groupBy("_cell").agg(*sides).toPandas()
        cuts.bound(boxes["_cell"].to_numpy(), boxes[lows].to_numpy(float), boxes[highs].to_numpy(float))

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                row, cell = cuts.within(rows["_root"].to_numpy(np.int64), points(rows), rows["_radius"].to_numpy(float))
                other = cell != rows["_cell"].to_numpy()[row]
                yield rows.iloc[row[other]].assign(_cell=cell[other].astype(np.int32))

        open_ = asking.where("_root > 0").join(reach, [*segment, "_sid"], "left").fillna({"_radius": float("inf")})
        visits = cut_lineage(open_.mapInPandas(visit, open_.schema).drop("_root"))
        more = closest_in_cells(visits, placed, segment, cells, features, k, block_rows, within="_radius")
        best = top_per_group(best.drop("position").unionByName(more), [*segment, "_sid"], ["distance", "_cid"], k, rank="position")
    return best.select(
        *segment, F.col("_sid").alias(subject), "position", F.col("_cid").alias(match), "distance"
    )


def closest_in_cells(
    visits: DataFrame, placed: DataFrame, segment: Sequence[str], cells: Sequence[str], features: Sequence[str], k: int, block_rows: int,
    within: str | None = None,
) -> DataFrame:
    """segment, _sid, _cid, distance: of every cell that a subject visits at least its ``k`` closest candidates.

    With ``within``, a column of ``visits``, only those that are no farther than it.

    ``visits`` has ``cells``, _sid and the features, ``placed`` the same with _cid. Cells of any size are
    met in blocks of about ``block_rows`` rows on both sides; each pair of blocks gives k rows a subject.
    """
    segment, cells, features = list(segment), list(cells), list(features)
    sizes = placed.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    # block counts on both sides keep every task's share bounded
    blocks = sizes.join(visits.groupBy(*cells).agg(F.count(F.lit(1)).alias("_v")), cells).select(
        *cells,
        F.ceil(F.col("_n") / block_rows).cast("int").alias("_cblocks"),
        F.ceil(F.col("_v") / block_rows).cast("int").alias("_vblocks"),
    )
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = (
        visits.join(blocks, cells)
        .withColumn("_vb", F.pmod(F.xxhash64("_sid"), F.col("_vblocks")).cast("int"))
        .withColumn("_cb", spread(F.col("_cblocks")))
        .select(*cells, "_cb", "_vb", "_sid", *features, *([within] if within else []))
    )
    right = (
        placed.join(blocks, cells)
        .withColumn("_cb", F.pmod(F.xxhash64("_cid"), F.col("_cblocks")).cast("int"))
        .withColumn("_vb", spread(F.col("_vblocks")))
        .select(*cells, "_cb", "_vb", "_cid", *features)
    )
    # fresh column identities: both sides descend from the same table
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    key = [*cells, "_cb", "_vb"]
    schema = T.StructType(
        [left.schema[c] for c in segment]
        + [left.schema["_sid"], right.schema["_cid"], T.StructField("distance", T.DoubleType())]
    )

    def closest_in_block(v: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if v.empty or c.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        c = c.sort_values("_cid", kind="stable")
        at, ids = c[features].to_numpy(float), c["_cid"].to_numpy()
        x, most = v[features].to_numpy(float), v[within].to_numpy(float) if within else None
        row, col, gap = closest_points(x, at, k, most)
        part = {s: v[s].to_numpy()[row] for s in segment}
        return pd.DataFrame(part | {"_sid": v["_sid"].to_numpy()[row], "_cid": ids[col], "distance": gap})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(closest_in_block, schema)


def weighted_estimate(
    comps: DataFrame, subject: str, position: str, value: str, weights: Sequence[float], name: str = "estimate"
) -> DataFrame:
    """Weighted sum of the matches' values by position; NULL unless every position has one."""
    scale = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col(position) - 1)
    k = len(weights)
    return comps.groupBy(subject).agg(
        F.when(F.count(F.when(F.col(position).between(1, k), F.col(value))) == k, F.sum(scale * F.col(value))).alias(name)
    )


def price_path(estimate: DataFrame, share: str, cap: float, later_caps: Sequence[float], digits: int | None = 2) -> DataFrame:
    """Amount for a percentage of the cap, and that amount as a percentage of later caps."""
    fix = (lambda x: F.bround(x, digits)) if digits is not None else (lambda x: x)
    out = estimate.withColumn("amount", fix(F.col(share) * cap / 100)).withColumn("share_season_1", F.col(share))
    return out.withColumns(
        {f"share_season_{i}": fix(F.col("amount") / c * 100) for i, c in enumerate(later_caps, start=2)}
    )
