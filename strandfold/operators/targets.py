"""Target prevalence, selection, class weights, top-k of a metric table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import split_attribute
from .cohort import scalar


def prevalence(mutations: DataFrame, samples: DataFrame) -> DataFrame:
    """Share of positive samples per target; the denominator is all samples, since absent rows are zeros."""
    positives = mutations.groupBy("target").agg(F.sum(F.col("label").cast("bigint")).alias("n_positive"))
    n = scalar(samples, F.count(F.lit(1)))
    return positives.withColumn("n_samples", n).withColumn("prevalence", F.col("n_positive") / F.col("n_samples"))


def top_rows(df: DataFrame, metric: str, key: str, k: int | None) -> DataFrame:
    """Best rows by a metric, ties by key; no k means all of them, sorted."""
    ordered = df.orderBy(F.desc(metric), F.asc(key))
    return ordered.limit(k) if k else ordered


def select_targets(
    mutations: DataFrame, samples: DataFrame, min_prevalence: float = 0.05, max_targets: int | None = None
) -> DataFrame:
    """Targets at or above the threshold; with ``max_targets`` only so many of them, by prevalence then name."""
    kept = prevalence(mutations, samples).filter(F.col("prevalence") >= min_prevalence)
    return top_rows(kept, "prevalence", "target", max_targets)


def keep_selected(mutations: DataFrame, samples: DataFrame, min_prevalence: float = 0.05, max_targets: int | None = None) -> DataFrame:
    chosen = select_targets(mutations, samples, min_prevalence, max_targets)
    return mutations.join(chosen.select("target"), "target", "left_semi")


def positive_weight(positives: Column, negatives: Column) -> Column:
    """negatives / positives within [1, 1e6]; 1 without positives."""
    ratio = F.try_divide(negatives.cast("double"), positives.cast("double"))
    return F.when(positives > 0, F.least(F.greatest(ratio, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1.0))


def class_weights(mutations: DataFrame, samples: DataFrame) -> DataFrame:
    """Per target: network weight, tree scale, and the balanced weight of either class."""
    counted = prevalence(mutations, samples).select(
        "target", "n_positive", (F.col("n_samples") - F.col("n_positive")).alias("n_negative"), "n_samples"
    )

    def balanced(count: str) -> Column:
        return F.col("n_samples") / (F.lit(2.0) * F.greatest(F.col(count), F.lit(1)))

    return counted.select(
        "target",
        "n_positive",
        "n_negative",
        positive_weight(F.col("n_positive"), F.col("n_negative")).alias("pos_weight"),
        (F.col("n_negative") / F.greatest(F.col("n_positive"), F.lit(1))).alias("tree_scale"),
        balanced("n_positive").alias("balanced_positive"),
        balanced("n_negative").alias("balanced_negative"),
    )


def status_labels(samples: DataFrame, key: str, positive: dict[str, str]) -> DataFrame:
    """0/1 labels from ``key: value`` attributes: a target is 1 where the key has exactly its value.

    ``samples``: sample_id, attributes (array<string>). ``positive``: target -> value. Samples without the
    key are left out.
    """
    stated = (
        samples.select("sample_id", F.explode("attributes").alias("text"))
        .select("sample_id", split_attribute(F.col("text")).alias("a"))
        .filter(F.col("a.key") == key)
    )
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(v).alias("value")) for t, v in positive.items()])
    return (
        stated.select("sample_id", F.col("a.value").alias("value"), F.explode(pairs).alias("p"))
        .groupBy("sample_id", F.col("p.target").alias("target"))
        .agg(F.max((F.col("value") == F.col("p.value")).cast("int")).alias("label"))
    )
