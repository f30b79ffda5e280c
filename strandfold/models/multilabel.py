"""Mutation status of many targets from expression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import align_features, dense_rows, long_rows, with_index
from ..operators.cohort import Cohort
from ..operators.collapse import collapse
from ..operators.folds import assign_folds
from ..operators.metrics import evaluate
from ..session import local_table, shared_dir
from ..sources.export import read_metadata, write_bundle
from .common import expression_of, feature_table, run_facts
from .explain import Explanation, explain_target, labelled_rows
from .network import Network, fit_folds, fit_network, resolve_settings

THRESHOLD = 0.5


@dataclass(frozen=True)
class MutationValidation:
    """Pooled out-of-fold scores per (sample, target), folds and run metadata; metrics are worked out when asked for."""

    scores: DataFrame
    folds: DataFrame
    metadata: dict

    @cached_property
    def metrics(self) -> DataFrame:
        return evaluate(self.scores)

    def write(self, path: str) -> str:
        tables = {"metrics": self.metrics, "oof_scores": self.scores, "fold_assignments": self.folds}
        return write_bundle(self.scores.sparkSession, path, tables, self.metadata)


def long_scores(scored: DataFrame, targets: list[str]) -> DataFrame:
    """``sample_id, target, probability, prediction`` from probability arrays."""
    long = long_rows(scored, targets, "probabilities", "target", "probability")
    return long.select(
        "sample_id", "target", F.col("probability").cast("double").alias("probability"),
        (F.col("probability") >= THRESHOLD).cast("int").alias("prediction"),
    )


@dataclass(frozen=True)
class Fitted:
    """A trained network with the names and fill values that belong to it."""

    network: Network
    features: list[str]
    targets: list[str]
    means: np.ndarray
    metadata: dict


class MultiLabelModel:
    """Fit on a cohort, then score, embed and explain any expression table; genes are matched by symbol."""

    def __init__(self, min_feature_overlap: float = 0.8, folds: int = 5, **settings):
        self.settings = resolve_settings(settings)
        self.min_feature_overlap, self.folds = min_feature_overlap, folds
        self.fitted: Fitted | None = None
        #: Share of the model's features that the last scored data had.
        self.feature_overlap: float | None = None

    @property
    def state(self) -> Fitted:
        """What fitting found."""
        if self.fitted is None:
            raise ValueError("This model is not fitted; use fit or load first.")
        return self.fitted

    network = property(lambda self: self.state.network)
    features = property(lambda self: self.state.features)
    targets = property(lambda self: self.state.targets)
    feature_means = property(lambda self: self.state.means)
    metadata = property(lambda self: self.fitted.metadata if self.fitted else {})

    # -------------------------------------------------------------- fit
    def _training(self, data: Cohort) -> tuple[DataFrame, list[str], np.ndarray, list[str]]:
        if data.mutations is None:
            raise ValueError("Mutation labels are required to train.")
        shared_dir(data.samples.sparkSession)
        features, means = feature_table(data.expression)
        targets = sorted(r["target"] for r in data.targets.collect())
        x = dense_rows(with_index(collapse(data.expression), features), data.samples, len(features), np.nan)
        labels = data.mutations.groupBy("sample_id", "target").agg(F.max("label").alias("value"))
        y = dense_rows(with_index(labels, targets, "target"), data.samples.select("sample_id"), len(targets), 0.0, "labels")
        return x.join(y, "sample_id"), features, means, targets

    def _described(self, rows: DataFrame, features: list[str], targets: list[str], **more) -> dict:
        """Facts of a run, for its bundle."""
        return run_facts(model=self.settings, n_samples=rows.count(), n_features=len(features), n_targets=len(targets), **more)

    def fit(self, data: Cohort) -> MultiLabelModel:
        dense, features, means, targets = self._training(data)
        dense = dense.checkpoint()
        named = data.samples.filter(F.col("cancer").isNotNull()).agg(F.sort_array(F.collect_set("cancer")).alias("c")).head()["c"]
        network = fit_network(dense, self.settings)
        self.fitted = Fitted(network, features, targets, means, self._described(dense, features, targets, cancers=named))
        return self

    # ---------------------------------------------------------- predict
    def align(self, data: Cohort | DataFrame, min_feature_overlap: float | None = None) -> DataFrame:
        """Dense rows in model order."""
        known, (expression, samples) = self.state, expression_of(data)
        least = self.min_feature_overlap if min_feature_overlap is None else min_feature_overlap
        dense, self.feature_overlap = align_features(expression, samples.select("sample_id"), known.features, known.means, least)
        return dense

    def predict(self, data: Cohort | DataFrame, min_feature_overlap: float | None = None) -> DataFrame:
        """``sample_id, target, probability, prediction``."""
        dense = self.align(data, min_feature_overlap)
        return long_scores(self.network.predict(dense), self.targets)

    def score_dense(self, dense: DataFrame) -> DataFrame:
        """Scores of rows that are already in model order; also for streaming frames."""
        return long_scores(self.network.predict(dense), self.targets)

    def embed(self, data: Cohort | DataFrame, min_feature_overlap: float | None = None) -> DataFrame:
        """``sample_id, embedding``."""
        dense = self.align(data, min_feature_overlap)
        return self.network.embed(dense)

    def head_weights(self, spark: SparkSession) -> DataFrame:
        """``target, weights``."""
        weights = pa.array([w.tolist() for w in self.network.head_weights()], pa.list_(pa.float32()))
        return local_table(spark, target=pa.array(self.targets, pa.string()), weights=weights)

    # ---------------------------------------------------------- explain
    def explain(
        self, data: Cohort, target: str, method: str = "gradient_boosting", min_feature_overlap: float = 1.0, **options
    ) -> Explanation:
        if target not in self.targets:
            raise ValueError(f"{target!r} is not in this model: it has {len(self.targets)} other targets.")
        if data.mutations is None:
            raise ValueError("Mutation labels are required to explain a target.")
        dense = labelled_rows(data, self.align(data, min_feature_overlap), target)
        options.setdefault("seed", self.settings["random_state"])
        return explain_target(dense, self.features, target, method, self.network, self.targets.index(target), **options)

    # --------------------------------------------------------- evaluate
    def cross_validate(self, data: Cohort) -> MutationValidation:
        """Metrics on pooled held-out scores: every sample is scored once, by the model of its fold."""
        dense, features, _, targets = self._training(data)
        dense = dense.checkpoint()
        folds, method = assign_folds(dense.select("sample_id", "cancer"), self.folds, self.settings["random_state"])
        folds = folds.checkpoint()
        table = dense.join(folds.select("sample_id", "fold"), "sample_id").checkpoint()
        scored = fit_folds(table, self.folds, self.settings).score_folds()
        truth = long_rows(table, targets, "labels", "target", "truth").withColumn("truth", F.col("truth").cast("int"))
        scores = (
            long_scores(scored, targets)
            .join(truth, ["sample_id", "target"])
            .join(folds.select("sample_id", "fold"), "sample_id")
            .checkpoint()
        )
        metadata = self._described(
            table, features, targets, folds=self.folds, split_method=method, classification_threshold=THRESHOLD,
            score_note="The weighted loss makes scores good for ranking, not probabilities.",
        )
        return MutationValidation(scores, folds, metadata)

    # ------------------------------------------------------ persistence
    def save(self, spark: SparkSession, path: str) -> str:
        """A directory of Parquet tables and one metadata row."""
        net = self.network
        names, shapes = zip(*net.shapes)
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        values = [part for part in np.split(net.parameters, ends[:-1])]
        history_schema = "epoch bigint, train_loss double, validation_loss double, learning_rate double"
        history = [tuple(h.get(c.split()[0]) for c in history_schema.split(", ")) for h in net.history]
        tables = {
            "layers": local_table(
                spark, name=pa.array(names), shape=pa.array([list(s) for s in shapes], pa.list_(pa.int32())),
                values=pa.array(values, pa.list_(pa.float32())),
            ),
            "features": local_table(
                spark, idx=pa.array(range(len(self.features)), pa.int32()), gene=pa.array(self.features, pa.string()),
                fill=pa.array(self.feature_means), mean=pa.array(net.mean), scale=pa.array(net.scale),
            ),
            "targets": local_table(
                spark, idx=pa.array(range(len(self.targets)), pa.int32()), target=pa.array(self.targets, pa.string())
            ),
            "history": spark.createDataFrame(history, history_schema),
        }
        metadata = {
            **self.metadata, "settings": self.settings, "min_feature_overlap": self.min_feature_overlap, "folds": self.folds,
        }
        return write_bundle(spark, path, tables, metadata)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MultiLabelModel:
        metadata = read_metadata(spark, path)
        model = cls(metadata["min_feature_overlap"], metadata["folds"], **metadata["settings"])
        genes = spark.read.parquet(f"{path}/features").orderBy("idx").toPandas()
        targets = [r["target"] for r in spark.read.parquet(f"{path}/targets").orderBy("idx").collect()]
        layers = spark.read.parquet(f"{path}/layers").toArrow().to_pydict()
        values = dict(zip(layers["name"], layers["values"], strict=True))
        network = Network(len(genes), len(targets), model.settings, np.zeros(0, "float32"), genes["mean"].to_numpy(), genes["scale"].to_numpy())
        network.parameters = np.concatenate([np.array(values[name], dtype="float32") for name, _ in network.shapes])
        network.history = [r.asDict() for r in spark.read.parquet(f"{path}/history").orderBy("epoch").collect()]
        model.fitted = Fitted(network, genes["gene"].tolist(), targets, genes["fill"].to_numpy(), metadata)
        return model

    def __repr__(self) -> str:
        known = f"{len(self.features)} features, {len(self.targets)} targets" if self.fitted else "nothing yet"
        return f"<MultiLabelModel of {known}>"
