"""Tree ensembles from pyspark.ml, and their exact path-dependent Shapley values."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

TREE_MODELS = ("gradient_boosting", "random_forest")
# Default parameters by model kind.
DEFAULT_PARAMS = {
    "gradient_boosting": {"n_estimators": 300, "learning_rate": 0.1, "max_depth": 3, "random_state": 42},
    "random_forest": {"n_estimators": 400, "max_depth": 10, "random_state": 42},
}


def _spark_params(kind: str, params: dict | None) -> dict:
    if kind not in TREE_MODELS:
        raise ValueError(f"Tree model must be one of {TREE_MODELS}; got {kind!r}.")
    given = {**DEFAULT_PARAMS[kind], **(params or {})}
    trees = given.pop("n_estimators")
    named = {"seed": given.pop("random_state"), "maxDepth": given.pop("max_depth")}
    named["maxIter" if kind == "gradient_boosting" else "numTrees"] = trees
    if kind == "gradient_boosting":
        named["stepSize"] = given.pop("learning_rate")
    named["cacheNodeIds"] = True
    named["checkpointInterval"] = 10
    return {**named, **given}


def make_regressor(kind: str, params: dict | None = None):
    """Regression forests look at every feature in each split, classification forests at a square root of them."""
    estimator = GBTRegressor if kind == "gradient_boosting" else RandomForestRegressor
    params = {"featureSubsetStrategy": "all", **(params or {})}
    return estimator(featuresCol="vector", labelCol="label", predictionCol="prediction", **_spark_params(kind, params))


def make_classifier(kind: str, params: dict | None = None):
    estimator = GBTClassifier if kind == "gradient_boosting" else RandomForestClassifier
    return estimator(
        featuresCol="vector", labelCol="label", weightCol="weight", predictionCol="prediction", **_spark_params(kind, params)
    )


def with_vector(dense: DataFrame) -> DataFrame:
    return dense.withColumn("vector", array_to_vector("features"))


def balanced_weights(dense: DataFrame) -> DataFrame:
    """Add ``weight``, rows / (2 x rows of the class); a single class is an error."""
    counts = {int(r["label"]): r["count"] for r in dense.groupBy("label").count().collect()}
    if len(counts) < 2:
        raise ValueError("The selected mutation target has only one class.")
    n = sum(counts.values())
    weight = F.when(F.col("label") == 1, F.lit(n / (2.0 * counts[1]))).otherwise(F.lit(n / (2.0 * counts[0])))
    return dense.withColumn("weight", weight)


class LeafPaths(NamedTuple):
    """Leaves that split on the same number of distinct features, one row per leaf.

    A leaf contributes ``value`` to a row that lies within (low, high] of every feature on its path; with a
    feature unknown, the share ``reach`` of the training weight takes the path anyway.
    """

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    reach: np.ndarray


def leaf_paths(spark: SparkSession, model) -> list[LeafPaths]:
    """Leaves of a fitted ensemble, read from its saved node table."""
    path = scratch_path(spark, "ensemble")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    is_forest_classifier = model.__class__.__name__ == "RandomForestClassificationModel"
    weights = [1.0 / len(model.trees)] * len(model.trees) if "RandomForest" in model.__class__.__name__ else model.treeWeights
    trees: dict[int, dict] = {}
    for node in nodes:
        trees.setdefault(node["treeID"], {})[node["id"]] = node

    def cover(node) -> float:
        stats = node["impurityStats"]
        return float(sum(stats)) if is_forest_classifier else float(stats[0])

    by_size: dict[int, list] = {}
    for tree, members in trees.items():
        pending = [(members[0], {})]
        while pending:
            node, path_so_far = pending.pop()
            if node["leftChild"] < 0:
                stats = node["impurityStats"]
                value = stats[1] / sum(stats) if is_forest_classifier else node["prediction"]
                by_size.setdefault(len(path_so_far), []).append((weights[tree] * value, path_so_far))
                continue
            split = node["split"]
            feature, threshold = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            low, high, reach = path_so_far.get(feature, (-np.inf, np.inf, 1.0))
            for child, bounds in (
                (members[node["leftChild"]], (low, min(high, threshold))),
                (members[node["rightChild"]], (max(low, threshold), high)),
            ):
                share = reach * cover(child) / cover(node)
                pending.append((child, {**path_so_far, feature: (*bounds, share)}))

    grouped = []
    for size, leaves in sorted(by_size.items()):
        bounds = np.array([list(p.values()) for _, p in leaves]).reshape(len(leaves), size, 3)
        grouped.append(
            LeafPaths(
                np.array([v for v, _ in leaves]),
                np.array([list(p) for _, p in leaves], dtype="int64").reshape(len(leaves), size),
                bounds[:, :, 0], bounds[:, :, 1], bounds[:, :, 2],
            )
        )
    return grouped


def base_value(paths: list[LeafPaths]) -> float:
    """Expected output over the training weight."""
    return float(sum((p.value * p.reach.prod(axis=1)).sum() for p in paths))


def shapley_values(x: np.ndarray, paths: list[LeafPaths], cells: int = 1 << 20) -> np.ndarray:
    """Exact Shapley values of every row of ``x``.

    On one path the game is a product: a known feature contributes whether the row passes (0 or 1), an
    unknown one its reach. The Shapley weights k!(d-1-k)!/d! are integrals of t^k (1-t)^(d-1-k), so feature
    i gets (passes_i - reach_i) times the integral over t of prod_{j != i} (t passes_j + (1-t) reach_j). That
    integrand has degree d - 1, which Gauss-Legendre with ceil(d / 2) points integrates exactly.
    """
    result = np.zeros(x.shape)
    for group in paths:
        size = group.feature.shape[1]
        if size == 0:
            continue
        points, weights = np.polynomial.legendre.leggauss((size + 1) // 2)
        points, weights = (points + 1.0) / 2.0, weights / 2.0
        step = max(1, cells // group.feature.size)
        for at in range(0, len(x), step):
            rows = x[at : at + step]
            seen = rows[:, group.feature]
            passes = ((seen > group.low) & (seen <= group.high)).astype("float64")
            integral = np.zeros(passes.shape)
            for t, w in zip(points, weights):
                factor = t * passes + (1.0 - t) * group.reach
                integral += w * factor.prod(axis=2, keepdims=True) / factor
            gain = group.value[None, :, None] * (passes - group.reach) * integral
            flat = group.feature.ravel()
            for r in range(len(rows)):
                result[at + r] += np.bincount(flat, weights=gain[r].ravel(), minlength=x.shape[1])
    return result


def tree_shap(dense: DataFrame, paths: list[LeafPaths]) -> DataFrame:
    """``sample_id, shap`` for dense rows; the leaf table is as large as the model and is broadcast."""
    # Plain tuples of arrays, which any executor can read.
    shared = dense.sparkSession.sparkContext.broadcast([tuple(p) for p in paths])

    def explain(batches):
        for batch in batches:
            if len(batch):
                x = np.stack(batch["features"].to_list())
                yield pd.DataFrame({"sample_id": batch["sample_id"], "shap": list(shapley_values(x, [LeafPaths(*p) for p in shared.value]))})

    return dense.select("sample_id", "features").mapInPandas(explain, "sample_id string, shap array<double>")
