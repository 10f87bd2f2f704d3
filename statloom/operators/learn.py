"""Classifiers, grid search, metrics, importances and partial dependence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators import histtrees


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def boosted_trees(
    rounds: int = 100, depth: int = 6, rate: float = 0.3, row_share: float = 1.0, column_share: float = 1.0, seed: int = 13
) -> GBTClassifier:
    return GBTClassifier(
        maxIter=rounds,
        maxDepth=depth,
        stepSize=rate,
        subsamplingRate=row_share,
        featureSubsetStrategy="all" if column_share >= 1 else str(column_share),
        seed=seed,
    )


@dataclass(frozen=True)
class ClassTrees:
    """The trees that tell one class from all others; ``featureImportances`` are shares of the splits' gains."""

    trees: list[list[histtrees.Tree]]
    features: int

    @property
    def featureImportances(self) -> DenseVector:
        gains = np.zeros(self.features)
        for tree in (t for r in self.trees for t in r):
            np.add.at(gains, tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0])
        return DenseVector(gains / (gains.sum() or 1.0))


@dataclass(frozen=True)
class OneVsRestTreesModel:
    boosted: histtrees.Boosted

    @property
    def models(self) -> list[ClassTrees]:
        return [ClassTrees(trees, len(self.boosted.bins.features)) for trees in self.boosted.trees]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``rawPrediction``, the margins of all classes, and ``prediction``, the first of the highest."""
        margins = histtrees.margins_of(self.boosted, range(len(self.boosted.trees)), vector_to_array("features"))
        out = df.withColumn("rawPrediction", margins)
        best = (F.array_position("rawPrediction", F.array_max("rawPrediction")) - 1).cast("double")
        return out.withColumn("prediction", best).withColumn("rawPrediction", array_to_vector("rawPrediction"))


@dataclass(frozen=True)
class OneVsRestTrees:
    """Boosted trees on shared bins, one model per class, all grown together; highest margin wins."""

    setting: histtrees.Setting
    seed: int = 13

    def fit(self, df: DataFrame) -> OneVsRestTreesModel:
        """Learn from the columns ``features`` and ``label`` (0, 1, ..)."""
        values = vector_to_array("features")
        told = df.agg(F.max("label").alias("last"), F.max(F.size(values)).alias("width")).first()
        if told["last"] is None or told["width"] is None:
            raise ValueError("no rows to learn from")
        names = [f"x{i}" for i in range(told["width"])]
        # the id is written with the bins, so samples are drawn by the same one whenever they are read
        rows = df.select("label", F.monotonically_increasing_id().alias("id"), *[F.get(values, F.lit(i)).alias(n) for i, n in enumerate(names)])
        bins = histtrees.find_bins(rows, names)
        settings = [replace(self.setting, target=k) for k in range(int(told["last"]) + 1)]
        return OneVsRestTreesModel(histtrees.fit(histtrees.bin_rows(rows, bins, "label", "id"), bins, settings, seed=self.seed))


def many_class_boosted_trees(
    rounds: int = 100, depth: int = 6, rate: float = 0.3, row_share: float = 1.0, column_share: float = 1.0, seed: int = 13
) -> OneVsRestTrees:
    """One model of boosted trees per class, highest score wins."""
    return OneVsRestTrees(histtrees.Setting(rounds, depth, rate, row_share, column_share), seed)


def forest(trees: int = 100, depth: int = 10, leaf_rows: int = 1, bootstrap: bool = True, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf_rows, bootstrap=bootstrap, seed=seed
    )


def grid_search(
    df: DataFrame, estimator, grid: Mapping[str, Sequence], fold: str, folds: int = 5, parallelism: int = 4, metric: str = "precisionByLabel"
) -> CrossValidatorModel:
    """Cross-validated search over every combination of the given parameter values; ``fold`` is an
    integer column in [0, folds)."""
    names = list(grid)
    maps = [
        {estimator.getParam(n): v for n, v in zip(names, values)} for values in product(*grid.values())
    ]
    evaluator = MulticlassClassificationEvaluator(metricName=metric, metricLabel=1.0)
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, foldCol=fold, parallelism=parallelism
    )
    return search.fit(df)


def search_table(model: CrossValidatorModel, df: DataFrame) -> DataFrame:
    """Average score per parameter combination."""
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name)), float(s))
        for m, s in zip(model.getEstimatorParamMaps(), model.avgMetrics)
    ]
    return df.sparkSession.createDataFrame(rows, "parameters string, score double")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def binary_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 from one pass."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    c = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == F.col(prediction)).alias("right"),
        F.count_if(y & p).alias("tp"),
        F.count_if(p).alias("predicted"),
        F.count_if(y).alias("actual"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return c.select(
        ratio("right", "n").alias("accuracy"),
        ratio("tp", "predicted").alias("precision"),
        ratio("tp", "actual").alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("actual")), F.lit(0.0)).alias("f1"),
    )


def micro_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Micro averages over classes: with one label per row all three equal the accuracy."""
    hit = F.avg(F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0))
    return df.agg(hit.alias("accuracy"), hit.alias("precision"), hit.alias("recall"))


def importances(model: Model, features: Sequence[str], df: DataFrame, least: float = 0.0) -> DataFrame:
    """Features with an importance of at least ``least``, most important first. A one-vs-rest model
    reports the average over its classes."""
    parts = getattr(model, "models", None) or [model]
    values = sum(m.featureImportances.toArray() for m in parts) / len(parts)
    rows = [(f, float(v)) for f, v in zip(features, values)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.filter(F.col("importance") >= least).orderBy(F.desc("importance"), "feature")


def partial_dependence(
    model: Model, df: DataFrame, features: Sequence[str], feature: str, points: Sequence[float]
) -> DataFrame:
    """Average predicted probability of class 1 with ``feature`` set to each point on every row."""
    at = list(features).index(feature)
    values = vector_to_array("features")
    moved = df.select("features", F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("point")).select(
        "point",
        array_to_vector(F.transform(values, lambda v, i: F.when(i == at, F.col("point")).otherwise(v))).alias("features"),
    )
    scored = model.transform(moved)
    return scored.groupBy("point").agg(F.avg(F.get(vector_to_array("probability"), F.lit(1))).alias("probability")).select(
        F.lit(feature).alias("feature"), "point", "probability"
    )
