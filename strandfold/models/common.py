"""What both model classes share: inputs, dense training tables, parallel folds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..operators.align import feature_stats
from ..operators.cohort import Cohort


# The facts that a run's metadata can state, by name.
FACTS = (
    "model", "target", "method", "output_scale", "cancers", "folds", "split_method", "n_samples", "n_features", "n_targets",
    "n_training_samples", "n_explained_samples", "top_features_saved_per_sample", "samples_without_coding_mutation_events",
    "classification_threshold", "score_note",
)


def run_facts(**facts) -> dict:
    """Metadata of a run, in the order of FACTS; a fact without a name there is an error."""
    if unknown := set(facts) - set(FACTS):
        raise ValueError(f"Not a fact of a run: {sorted(unknown)}")
    return {name: facts[name] for name in FACTS if name in facts}


def expression_of(data: Cohort | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expression cells and the samples to score, from a cohort or a bare expression table."""
    if isinstance(data, Cohort):
        return data.expression, data.samples
    return data, data.select("sample_id").distinct()


def feature_table(expression: DataFrame) -> tuple[list[str], np.ndarray]:
    """Gene names in order and their means; one row per gene comes to the driver."""
    rows = sorted(feature_stats(expression).select("gene", "mean").collect(), key=lambda r: r["gene"])
    means = np.array([np.nan if r["mean"] is None else r["mean"] for r in rows], dtype="float64")
    return [r["gene"] for r in rows], means


def over_folds(spark: SparkSession, k: int, parallelism: int, run: Callable[[int], DataFrame]) -> DataFrame:
    """Run the folds with a few at a time in flight and stack their held-out rows."""
    pool = ThreadPool(min(k, parallelism))
    try:
        parts = pool.map(inheritable_thread_target(spark)(run), range(1, k + 1))
    finally:
        pool.close()
    return reduce(DataFrame.unionByName, parts)


