"""Partial dependence of all features at once, from the structure of fitted trees.

The partial dependence of feature j at v is the average score of all rows with j set to v. Setting j does
not change which conditions on other features a row meets. So for every leaf it is enough to know how many
rows meet its conditions, and how many meet all but those on j: both counts come from one pass over the
rows, whatever the number of features and points. A leaf then counts with the first number for features it
does not ask about, and with the second at the points inside its own interval of j. The result equals the
average over (rows x points) up to the order of the sums.

A tree model's nodes are read from its saved form. Counts have one row for each task, leaf and feature of
its path; what is added up on the driver has the size of the model, not of the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.selection import quantiles
from statloom.session import shared_folder

ANY = -1


@dataclass(frozen=True)
class Leaf:
    """What a leaf adds to the score, and for each feature of its path the interval low < x <= high."""

    value: float
    intervals: Mapping[int, tuple[float, float]]


def leaves_of(model: Model, df: DataFrame) -> list[Leaf]:
    """The leaves of a forest (share of class 1, divided by the number of trees) or of boosted trees
    (their weighted part of the margin)."""
    path = f"{shared_folder(df.sparkSession)}/statloom-model-{uuid.uuid4().hex}"
    model.write().save(path)
    read = df.sparkSession.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict[int, object]] = {}
    for node in read:
        trees.setdefault(node["treeID"], {})[node["id"]] = node
    boosted = not hasattr(model, "numClasses") or "GBT" in type(model).__name__
    weights = model.treeWeights
    found: list[Leaf] = []
    for t, nodes in trees.items():
        stack = [(0, {})]
        while stack:
            at, intervals = stack.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                stats = node["impurityStats"]
                value = node["prediction"] * weights[t] if boosted else stats[1] / sum(stats) / len(trees)
                found.append(Leaf(float(value), intervals))
                continue
            split = node["split"]
            if split["numCategories"] != -1:
                raise ValueError("only continuous features are supported")
            j, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            low, high = intervals.get(j, (-np.inf, np.inf))
            stack.append((node["leftChild"], intervals | {j: (low, min(high, cut))}))
            stack.append((node["rightChild"], intervals | {j: (max(low, cut), high)}))
    return found


def leaf_counts(df: DataFrame, leaves: Sequence[Leaf], features: str = "features") -> dict[tuple[int, int], int]:
    """(leaf, feature): rows that meet all conditions but those on the feature; (leaf, ANY): all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [(k, j) for k, leaf in enumerate(leaves) for j in (ANY, *leaf.intervals)]
        sums = np.zeros(len(keys), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T
            inside: dict[tuple, np.ndarray] = {}
            at = 0
            for leaf in leaves:
                outs = []
                for j, (low, high) in leaf.intervals.items():
                    key = (j, low, high)
                    if key not in inside:
                        inside[key] = ~((x[j] > low) & (x[j] <= high))
                    outs.append(inside[key])
                missed = np.zeros(batch.num_rows, np.int16)
                for out in outs:
                    missed += out
                met = int(np.count_nonzero(missed == 0))
                sums[at] += met
                once = missed == 1
                for i, out in enumerate(outs, 1):
                    sums[at + i] += met + int(np.count_nonzero(once & out))
                at += len(outs) + 1
        yield pa.RecordBatch.from_pydict(
            {
                "leaf": pa.array([k for k, _ in keys], pa.int32()),
                "feature": pa.array([j for _, j in keys], pa.int32()),
                "n": pa.array(sums, pa.int64()),
            }
        )

    arrays = df.select(vector_to_array(features).alias("x"))
    counted = arrays.mapInArrow(count, "leaf int, feature int, n long").groupBy("leaf", "feature").agg(F.sum("n").alias("n"))
    return {(r["leaf"], r["feature"]): r["n"] for r in counted.collect()}


def grid_points(
    df: DataFrame, features: Sequence[str], resolution: int = 100, ends: tuple[float, float] = (0.05, 0.95)
) -> dict[str, list[float]]:
    """Points between two exact quantiles of each feature; all its values if there are fewer than ``resolution``."""
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "feature", "value")
    edges = {(r["feature"], r["point"]): r["value"] for r in quantiles(long, ["feature"], "value", ends).collect()}
    points = {}
    for f in features:
        few = df.select(F.col(f).cast("double")).where(F.col(f).isNotNull()).distinct().limit(resolution).collect()
        points[f] = sorted(r[0] for r in few) if len(few) < resolution else np.linspace(edges[f, ends[0]], edges[f, ends[1]], resolution).tolist()
    return points


def partial_dependences(
    model: Model, df: DataFrame, features: Sequence[str], points: Mapping[str, Sequence[float]]
) -> DataFrame:
    """feature, point, score: the average score of all rows with one feature set to a point.

    The score is the probability of class 1 for a forest, the margin for boosted trees. ``df`` holds the
    assembled features in ``features`` order; no rows give no result.
    """
    leaves = leaves_of(model, df)
    counts = leaf_counts(df, leaves)
    n = df.count()
    rows = []
    for j, f in enumerate(features):
        at = np.asarray(points.get(f, []), float)
        total = np.zeros(len(at))
        for k, leaf in enumerate(leaves):
            if j in leaf.intervals:
                low, high = leaf.intervals[j]
                total += np.where((at > low) & (at <= high), counts.get((k, j), 0) * leaf.value, 0.0)
            else:
                total += counts.get((k, ANY), 0) * leaf.value
        rows += [(f, float(p), float(v) / n) for p, v in zip(at, total)] if n else []
    return df.sparkSession.createDataFrame(rows, "feature string, point double, score double")
