"""Boosted trees on shared bins: many models, and all classes of each, grown together.

Features are cut into bins once, at exact quantiles. A pass over the binned rows then serves every model
and every class: each task adds gradients and second derivatives to one histogram for each open node, tasks'
histograms meet under their node, and the best split of a node is chosen where they meet. A level of all
trees of a round costs one pass, so a grid search with folds takes as many passes as its deepest and
longest model, not their sum. Models that differ only in the number of rounds are one model, scored at
several stages.

With one class the objective is logistic, with more it is the soft-max over the classes, one tree for each
class and round. A leaf's value is -G / (H + penalty), times the rate; a split is taken for the greatest
gain in G^2 / (H + penalty), the first of equal ones by feature and bin.

Rows with the same bins, label and fold stay alike through all rounds, so ``fit`` keeps one of them and their
number, unless a setting samples rows. Each row carries its margins; they are written anew every ``CUT`` rounds, and the trees since then are
walked on the way. Where the rows that ``fit`` keeps take at most ``DRIVER_BYTES`` and more than ``FEW_PASSES``
passes lie ahead, they are sent to one task for each model, which grows all its rounds by itself, without passes.
The driver holds the trees. A histogram has (features x bins) pairs of numbers, one a
task and open node; where all of a level's are at most ``DRIVER_BYTES``, they meet on the driver, which saves
a shuffle a level. Rows with a missing feature or label take no part. Row samples are drawn by a hash of
the row's key and the round, so that lost tasks draw the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.selection import quantiles
from statloom.session import cut_lineage

#: Rounds whose trees are walked before margins are written again.
CUT = 10
#: Histograms of a level, over all tasks, that may meet on the driver.
DRIVER_BYTES = 16 << 20
#: Passes up to which gathering the rows is not worth a job of its own.
FEW_PASSES = 30
MIN_WEIGHT = 1.0


@dataclass(frozen=True)
class Setting:
    """What one model is fitted with; ``left_out`` is the fold that it does not learn from."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    row_share: float = 1.0
    column_share: float = 1.0
    penalty: float = 1.0
    left_out: int | None = None
    #: The label that a model with one class of margins tells from all others.
    target: int = 1


@dataclass(frozen=True)
class Bins:
    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]

    @property
    def most(self) -> int:
        return max(len(c) for c in self.cuts) + 1


@dataclass
class Tree:
    """Nodes by number: the children of i are 2i + 1 (bin <= cut) and 2i + 2; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n), np.zeros(n, np.float32))

    def split(self, at: int, chosen: Mapping, setting: Setting) -> bool:
        """Give node ``at`` the split that was chosen, or its value if there is none."""
        leaf = lambda g, h: -g / (h + setting.penalty) * setting.rate
        if chosen["feature"] < 0:
            self.value[at] = leaf(chosen["g"], chosen["h"])
            return False
        self.feature[at], self.cut[at], self.gain[at] = chosen["feature"], chosen["cut"], chosen["gain"]
        self.value[2 * at + 1] = leaf(chosen["gl"], chosen["hl"])
        self.value[2 * at + 2] = leaf(chosen["g"] - chosen["gl"], chosen["h"] - chosen["hl"])
        return True

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            if not (f >= 0).any():
                break
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at


@dataclass
class Boosted:
    """Fitted models: ``trees[model][round][class]``."""

    bins: Bins
    settings: list[Setting]
    classes: int
    trees: list[list[list[Tree]]] = field(default_factory=list)


def find_bins(df: DataFrame, features: Sequence[str], bins: int = 64) -> Bins:
    """Cut points at exact quantiles; x belongs to the first bin whose cut is >= x."""
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "feature", "value")
    points = [i / bins for i in range(1, bins)]
    found: dict[str, set] = {f: set() for f in features}
    for r in quantiles(long.where(~F.isnan("value")), ["feature"], "value", points).collect():
        found[r["feature"]].add(r["value"])
    return Bins(tuple(features), tuple(tuple(sorted(found[f])) for f in features))


def bin_rows(df: DataFrame, bins: Bins, label: str, key: str, fold: str | None = None) -> DataFrame:
    """row, label, fold, bins (one byte a feature), margins: the written table that ``fit`` and ``scores`` read."""
    cuts = [np.array(c) for c in bins.cuts]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [c.to_numpy(zero_copy_only=False) for c in batch.columns[3:]]
            placed = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x)]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _packed(placed)], ["row", "label", "fold", "bins"])

    if bins.most > 256:
        raise ValueError("at most 256 bins")
    read = df.select(
        F.xxhash64(key).alias("row"),
        F.col(label).cast("int").alias("label"),
        (F.lit(-1) if fold is None else F.col(fold)).cast("int").alias("fold"),
        *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(bins.features)],
    ).dropna()
    for i in range(len(bins.features)):
        read = read.where(~F.isnan(f"f{i}"))
    binned = read.mapInArrow(cut, "row long, label int, fold int, bins binary")
    return cut_lineage(binned.withColumn("margins", F.lit(None).cast("binary")))


def _unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of a binary column whose values are ``width`` numbers each, without a copy."""
    n, (_, offsets, data) = len(column), column.buffers()
    whole = np.dtype(np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    start = int(np.frombuffer(offsets, whole, 1, whole.itemsize * column.offset)[0])
    return np.frombuffer(data, kind, n * width, start).reshape(n, width)


def _packed(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _bins(batch: pa.RecordBatch, features: int) -> np.ndarray:
    return _unpacked(batch.column("bins"), np.uint8, features)


def _columns(batch: pa.RecordBatch, features: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins and margins of the rows."""
    kept = batch.column("margins")
    margins = np.zeros((batch.num_rows, width)) if kept.null_count else _unpacked(kept, np.float64, width).copy()
    return _bins(batch, features), margins


def _walk(bins: np.ndarray, margins: np.ndarray, recent: Sequence[Sequence[Sequence[Tree]]], depths: Sequence[int], classes: int) -> None:
    """Add what trees give to margins; ``recent[model]`` lists rounds of trees."""
    for m, rounds in enumerate(recent):
        for trees in rounds:
            for k, tree in enumerate(trees):
                margins[:, m * classes + k] += tree.value[tree.nodes(bins, depths[m])]


def probabilities(margins: np.ndarray) -> np.ndarray:
    """Of each class; of class 1 if there is one column of margins."""
    if margins.shape[1] == 1:
        return 1 / (1 + np.exp(-margins))
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, label: np.ndarray, target: int = 1) -> tuple[np.ndarray, np.ndarray]:
    p = probabilities(margins)
    y = (label[:, None] == (target if margins.shape[1] == 1 else np.arange(margins.shape[1]))).astype(float)
    scale = 1.0 if margins.shape[1] == 1 else 2.0
    return p - y, np.maximum(scale * p * (1 - p), 1e-16)


def _drawn(row: np.ndarray, share: float, model: int, round_: int) -> np.ndarray:
    """Rows of a sample, by a hash of the row's key."""
    if share >= 1:
        return np.ones(len(row), bool)
    h = row.astype(np.uint64) + np.uint64((model * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(float) / 2**53 < share


def best_split(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int, int, float, float, float, float]:
    """(gain, feature, cut, G and H left, G and H in all) from (features x bins) sums; gain 0 without a split."""
    g_all, h_all = float(g[0].sum()), float(h[0].sum())
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    gr, hr = g_all - gl, h_all - hl
    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - g_all**2 / (h_all + penalty)
    gain = np.where((hl >= MIN_WEIGHT) & (hr >= MIN_WEIGHT), gain, 0.0)
    if gain.size == 0 or gain.max() <= 1e-12:
        return 0.0, -1, 0, 0.0, 0.0, g_all, h_all
    f, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[f, cut]), int(f), int(cut), float(gl[f, cut]), float(hl[f, cut]), g_all, h_all


def _choice(both: np.ndarray, tree: int, node: int, columns, settings, classes: int) -> dict:
    """The best split of a node from its sums, by name."""
    m = tree // classes
    used = columns[m]
    gain, f, *rest = best_split(both[0][used], both[1][used], settings[m].penalty)
    names = ["tree", "node", "gain", "feature", "cut", "gl", "hl", "g", "h"]
    return dict(zip(names, [tree, node, gain, int(used[f]) if f >= 0 else -1, *rest]))


def _level(table: DataFrame, tasks: int, recent, growing, live, columns, settings, classes: int, features: int, n_bins: int, round_: int, level: int):
    """The best split of every open node of one level: rows (tree, node, gain, feature, cut, sums)."""
    depths = [s.depth for s in settings]
    width = len(settings) * classes
    first, count = 2**level - 1, 2**level
    size = features * n_bins

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, margins = _columns(batch, features, width)
            _walk(bins, margins, recent, depths, classes)
            row, label, fold, n = (batch.column(c).to_numpy() for c in ("row", "label", "fold", "n"))
            flat = bins + np.arange(features) * n_bins
            for m in live:
                s = settings[m]
                learn = _drawn(row, s.row_share, m, round_)
                if s.left_out is not None:
                    learn &= fold != s.left_out
                g, h = gradients(margins[:, m * classes : (m + 1) * classes], label, s.target)
                for k in range(classes):
                    if growing[m][k] is None:
                        continue
                    nodes = growing[m][k].nodes(bins, level)
                    own = np.flatnonzero(learn & (nodes >= first))
                    place = ((nodes[own] - first)[:, None] * size + flat[own]).ravel()
                    # the third row counts, so that nodes without rows are left out
                    both = sums.setdefault(m * classes + k, np.zeros((3, count * size)))
                    for i, x in enumerate((g[:, k] * n, h[:, k] * n)):
                        both[i] += np.bincount(place, np.repeat(x[own], features), count * size)
                    both[2] += np.bincount(place, minlength=count * size)
        found = [
            (tree, node, both[:2, node].tobytes())
            for tree, both in ((t, x.reshape(3, count, size)) for t, x in sums.items())
            for node in np.flatnonzero(both[2].any(axis=1)).tolist()
        ]
        types = {"tree": pa.int32(), "node": pa.int32(), "sums": pa.binary()}
        yield pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in found], t) for i, (c, t) in enumerate(types.items())})

    unpacked = lambda v: np.frombuffer(v, np.float64).reshape(2, features, n_bins)

    def choose(group: pa.Table) -> pa.Table:
        both = sum(unpacked(v) for v in group.column("sums").to_pylist())
        tree, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        chosen = _choice(both, tree, node, columns, settings, classes)
        types = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(chosen.values(), types)], list(chosen))

    added = table.mapInArrow(add, "tree int, node int, sums binary")
    if tasks * len(live) * classes * count * size * 16 <= DRIVER_BYTES:
        met: dict[tuple[int, int], np.ndarray] = {}
        for r in added.collect():
            met[r["tree"], r["node"]] = met.get((r["tree"], r["node"]), 0.0) + unpacked(r["sums"])
        return [_choice(both, tree, node, columns, settings, classes) for (tree, node), both in met.items()]
    schema = "tree int, node int, gain double, feature int, cut int, gl double, hl double, g double, h double"
    return added.groupBy("tree", "node").applyInArrow(choose, schema).collect()


def _gathered(table: DataFrame, features: int) -> tuple[np.ndarray, ...] | None:
    """row, label, fold, n and bins of all rows, or None where they take more than ``DRIVER_BYTES``."""
    if table.count() * (28 + features) > DRIVER_BYTES:
        return None
    held = table.select("row", "label", "fold", "n", "bins").toArrow().combine_chunks()
    if not held.num_rows:
        return None
    placed = np.frombuffer(b"".join(held.column("bins").to_pylist()), np.uint8).reshape(-1, features)
    return (*(held.column(c).to_numpy() for c in ("row", "label", "fold", "n")), placed)


def _tree(bins: np.ndarray, flat: np.ndarray, g: np.ndarray, h: np.ndarray, tree: int, used: np.ndarray, settings, classes: int, features: int, n_bins: int) -> Tree:
    """A tree from all rows that it learns from."""
    setting, size = settings[tree // classes], features * n_bins
    columns = [None] * (tree // classes) + [used]
    grown, at, rows = Tree.empty(setting.depth), np.zeros(len(bins), np.int64), np.arange(len(bins))
    for level in range(setting.depth):
        first, count = 2**level - 1, 2**level
        node = at[rows] - first
        place = (node[:, None] * size + flat[rows]).ravel()
        both = [np.bincount(place, np.repeat(x[rows], features), count * size).reshape(count, features, n_bins) for x in (g, h)]
        split = np.zeros(count, bool)
        for k in np.flatnonzero(np.bincount(node, minlength=count)).tolist():
            chosen = _choice(np.stack([both[0][k], both[1][k]]), tree, k, columns, settings, classes)
            split[k] = grown.split(first + k, chosen, setting)
        rows = rows[split[node]]
        if not len(rows):
            break
        here = at[rows]
        at[rows] = 2 * here + 1 + (bins[rows, grown.feature[here]] > grown.cut[here])
    return grown


def _in_tasks(spark, held: tuple[np.ndarray, ...], settings, classes: int, features: int, n_bins: int, columns) -> list[list[list[Tree]]]:
    """All trees of all models, each model grown by one task that holds all rows; ``columns[round][model]``."""
    # the longest first
    order = sorted(range(len(settings)), key=lambda m: -settings[m].rounds * settings[m].depth)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in (order[i] for i in batch.column(0).to_pylist()):
                s = settings[m]
                row, label, fold, n, bins = held if s.left_out is None else (x[held[2] != s.left_out] for x in held)
                flat, margins, trees = bins + np.arange(features) * n_bins, np.zeros((len(bins), classes)), []
                for r in range(s.rounds):
                    learn = _drawn(row, s.row_share, m, r)
                    g, h = gradients(margins, label, s.target)
                    g, h = g * n[:, None], h * n[:, None]
                    own = (bins, flat, g, h) if learn.all() else (bins[learn], flat[learn], g[learn], h[learn])
                    grown = [_tree(*own[:2], own[2][:, k], own[3][:, k], m * classes + k, columns[r][m], settings, classes, features, n_bins) for k in range(classes)]
                    for k, tree in enumerate(grown):
                        margins[:, k] += tree.value[tree.nodes(bins, s.depth)]
                    trees += grown
                packed = [np.concatenate([getattr(t, c) for t in trees] or [getattr(Tree.empty(0), c)[:0]]).tobytes() for c in ("feature", "cut", "value", "gain")]
                columns_ = [pa.array([m], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)]
                yield pa.RecordBatch.from_arrays(columns_, ["model", "feature", "cut", "value", "gain"])

    models = spark.range(0, len(settings), 1, len(settings))
    told = models.mapInArrow(grow, "model int, feature binary, cut binary, value binary, gain binary").collect()
    out: list = [None] * len(settings)
    for t in told:
        s = settings[t["model"]]
        kinds = {"feature": np.int16, "cut": np.int16, "value": np.float64, "gain": np.float32}
        arrays = [np.frombuffer(t[c], kind).reshape(s.rounds, classes, 2 ** (s.depth + 1) - 1) for c, kind in kinds.items()]
        out[t["model"]] = [[Tree(*(a[r, k] for a in arrays)) for k in range(classes)] for r in range(s.rounds)]
    return out


def fit(table: DataFrame, bins: Bins, settings: Sequence[Setting], classes: int = 1, seed: int = 13) -> Boosted:
    """Fit all ``settings`` side by side on a table made by ``bin_rows``. Labels are 0, 1, .. ``classes`` - 1
    (0 and 1 with one class)."""
    settings = list(settings)
    model = Boosted(bins, settings, classes, [[] for _ in settings])
    features, width = len(bins.features), len(settings) * classes
    rng = np.random.default_rng(seed)
    recent: list[list[list[Tree]]] = [[] for _ in settings]
    if all(s.row_share >= 1 for s in settings):
        alike = table.groupBy("label", "fold", "bins").agg(F.count(F.lit(1)).alias("n"))
        table = alike.select(F.lit(0).cast("bigint").alias("row"), "label", "fold", "bins", F.lit(None).cast("binary").alias("margins"), "n")
        table = cut_lineage(table)
    else:
        table = table.withColumn("n", F.lit(1).cast("bigint"))
    rounds = max((s.rounds for s in settings), default=0)
    drawn: list[list] = [[None] * len(settings) for _ in range(rounds)]
    for r in range(rounds):
        for m in (m for m, s in enumerate(settings) if r < s.rounds):
            used = max(1, round(settings[m].column_share * features))
            drawn[r][m] = np.sort(rng.permutation(features)[:used])
    if rounds * max((s.depth for s in settings), default=0) > FEW_PASSES:
        held = _gathered(table, features)
        if held is not None:
            model.trees = _in_tasks(table.sparkSession, held, settings, classes, features, bins.most, drawn)
            return model
    tasks = table.rdd.getNumPartitions()
    for r in range(rounds):
        live = [m for m, s in enumerate(settings) if r < s.rounds]
        growing: list = [None] * len(settings)
        columns = drawn[r]
        for m in live:
            growing[m] = [Tree.empty(settings[m].depth) for _ in range(classes)]
        # trees that may still have an open node on the level
        open_ = {(m, k) for m in live for k in range(classes)}
        for level in range(max(settings[m].depth for m in live)):
            open_ = {(m, k) for m, k in open_ if level < settings[m].depth}
            if not open_:
                break
            shown = [[growing[m][k] if (m, k) in open_ else None for k in range(classes)] if m in live else None for m in range(len(settings))]
            found = _level(table, tasks, recent, shown, sorted({m for m, _ in open_}), columns, settings, classes, features, bins.most, r, level)
            split = set()
            for row in found:
                m, k = divmod(row["tree"], classes)
                if growing[m][k].split(2**level - 1 + row["node"], row, settings[m]):
                    split.add((m, k))
            open_ &= split
        for m in live:
            model.trees[m].append(growing[m])
            recent[m].append(growing[m])
        if (r + 1) % CUT == 0:
            table = _with_margins(table, recent, settings, classes, features, width)
            tasks = table.rdd.getNumPartitions()
            recent = [[] for _ in settings]
    return model


def _with_margins(table: DataFrame, recent, settings, classes: int, features: int, width: int) -> DataFrame:
    depths = [s.depth for s in settings]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, margins = _columns(batch, features, width)
            _walk(bins, margins, recent, depths, classes)
            at = batch.schema.get_field_index("margins")
            yield batch.set_column(at, "margins", _packed(margins))

    return cut_lineage(table.mapInArrow(walk, table.schema))


def scores(model: Boosted, table: DataFrame, stages: Sequence[Sequence[int]] | None = None, only_left_out: bool = False) -> DataFrame:
    """model, rounds, label, prediction, n: what every model, cut off after some rounds, says of the rows.

    With ``only_left_out`` a model is asked only about the fold that it did not learn from.
    """
    stages = [[s.rounds] for s in model.settings] if stages is None else [sorted(s) for s in stages]
    features, classes = len(model.bins.features), model.classes

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            all_bins = _bins(batch, features)
            label, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for m, s in enumerate(model.settings):
                mine = fold == s.left_out if only_left_out else np.ones(len(fold), bool)
                bins, y = all_bins[mine], label[mine]
                margins = np.zeros((len(bins), classes))
                for r in range(max(stages[m]) + 1):
                    if r in stages[m]:
                        guess = (margins[:, 0] > 0).astype(int) if classes == 1 else margins.argmax(axis=1)
                        pairs, n = np.unique(np.column_stack([y, guess]), axis=0, return_counts=True)
                        for (a, b), c in zip(pairs.tolist(), n.tolist()):
                            seen[m, r, a, b] = seen.get((m, r, a, b), 0) + c
                    if r < max(stages[m]):
                        _walk(bins, margins, [[model.trees[m][r]]], [s.depth], classes)
        columns = list(zip(*[(*key, n) for key, n in seen.items()])) or [[]] * 5
        types = [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["model", "rounds", "label", "prediction", "n"])

    said = table.mapInArrow(say, "model int, rounds int, label int, prediction int, n long")
    return said.groupBy("model", "rounds", "label", "prediction").agg(F.sum("n").alias("n"))


def margins_of(model: Boosted, which: Sequence[int], arrays: Column, given: Callable[[np.ndarray], np.ndarray] = lambda m: m) -> Column:
    """The margins that the models ``which`` give to an array of features, side by side, or what ``given`` makes of them."""
    trees, depths, classes = [model.trees[m] for m in which], [model.settings[m].depth for m in which], model.classes
    cuts = [np.array(c) for c in model.bins.cuts]

    @F.pandas_udf("array<double>")
    def ask(x):
        values = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(cuts)))
        bins = np.column_stack([np.searchsorted(c, values[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.int16)
        # rows alike are asked about once
        _, one, of = np.unique(np.ascontiguousarray(bins).view(f"V{2 * len(cuts)}").ravel(), return_index=True, return_inverse=True)
        margins = np.zeros((len(one), len(trees) * classes))
        _walk(bins[one], margins, trees, depths, classes)
        return type(x)(list(given(margins)[of]))

    return ask(arrays)


def predicted(model: Boosted, df: DataFrame, which: int = 0) -> DataFrame:
    """Add ``probabilities`` (of class 1, or of every class) and ``prediction`` by one of the models."""
    classes = model.classes
    arrays = F.array(*[F.col(f).cast("double") for f in model.bins.features])
    complete = F.forall(arrays, lambda v: v.isNotNull())
    out = df.where(complete).withColumn("probabilities", margins_of(model, [which], arrays, probabilities))
    p = F.col("probabilities")
    best = (F.get(p, F.lit(0)) > 0.5).cast("int") if classes == 1 else F.array_position(p, F.array_max(p)).cast("int") - 1
    return out.withColumn("prediction", best)


def search(df: DataFrame, features: Sequence[str], label: str, key: str, fold: str, folds: int, grid: Mapping[str, Sequence], bins: int = 64) -> DataFrame:
    """parameters, score: average precision of class 1 over folds for every combination of ``grid``.

    ``grid`` maps names of ``Setting`` to values. All combinations and folds are grown together; those that
    differ only in ``rounds`` are the same trees, scored at several stages.
    """
    others = {n: v for n, v in grid.items() if n != "rounds"}
    stages = sorted(grid.get("rounds", [100]))
    combos = [dict(zip(others, values)) for values in product(*others.values())]
    settings = [Setting(rounds=stages[-1], left_out=f, **c) for c in combos for f in range(folds)]
    cut = find_bins(df, features, bins)
    table = bin_rows(df, cut, label, key, fold)
    told = scores(fit(table, cut, settings), table, [stages] * len(settings), only_left_out=True)
    named = [
        (m, r, ", ".join(f"{n}={v}" for n, v in sorted((combos[m // folds] | {"rounds": r}).items())))
        for m in range(len(settings))
        for r in stages
    ]
    names = df.sparkSession.createDataFrame(named, "model int, rounds int, parameters string")
    hit, said = F.sum(F.when((F.col("label") == 1) & (F.col("prediction") == 1), F.col("n"))), F.sum(F.when(F.col("prediction") == 1, F.col("n")))
    per_fold = told.groupBy("model", "rounds").agg(F.coalesce(F.try_divide(hit, said), F.lit(0.0)).alias("precision"))
    return names.join(per_fold, ["model", "rounds"], "left").groupBy("parameters").agg(F.avg(F.coalesce("precision", F.lit(0.0))).alias("score"))
