"""Seeded fold assignment and seeded sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import seeded_ordinals


def plain_folds(samples: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """k folds of near-equal size in seeded order; the first ``n mod k`` folds hold one more."""
    ranked = seeded_ordinals(samples, "sample_id", seed)
    size = F.expr(f"total div {k}")
    larger = F.col("total") % k
    in_larger = larger * (size + 1)
    r = F.col("ordinal") - 1
    fold = F.when(r < in_larger, F.floor(r / (size + 1)) + 1).otherwise(
        larger + F.floor(F.try_divide(r - in_larger, size)) + 1
    )
    return ranked.withColumn("fold", fold.cast("bigint")).drop("ordinal", "total")


def stratified_folds(samples: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds dealt round-robin through the cohorts, so they differ by at most one per cohort and overall."""
    ranked = seeded_ordinals(samples, "sample_id", seed, "cancer")
    sizes = samples.groupBy("cancer").agg(F.count(F.lit(1)).alias("_n"))
    # One row per cohort: the only unpartitioned window, over as many rows as there are cohorts.
    starts = sizes.select(
        F.col("cancer").alias("_cohort"),
        F.coalesce(
            F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("cancer").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
    )
    placed = ranked.join(starts, F.col("cancer").eqNullSafe(F.col("_cohort")))
    fold = (F.col("_start") + F.col("ordinal") - 1) % k + 1
    return placed.withColumn("fold", fold.cast("bigint")).drop("ordinal", "total", "_start", "_cohort")


def assign_folds(samples: DataFrame, k: int = 5, seed: int = 42) -> tuple[DataFrame, str]:
    """``sample_id, cancer, fold`` and the method used.

    Stratified when there are at least two cohorts and the smallest can fill every fold.
    """
    sizes = samples.groupBy("cancer").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.agg(
        F.sum("n").alias("n"),
        F.count("cancer").alias("cohorts"),
        F.min(F.when(F.col("cancer").isNotNull(), F.col("n"))).alias("smallest"),
    ).first()
    if (shape["n"] or 0) < k:
        raise ValueError(f"{shape['n'] or 0} samples are too few for {k} folds.")
    if shape["cohorts"] > 1 and shape["smallest"] >= k:
        return stratified_folds(samples, k, seed).select("sample_id", "fold", "cancer"), "stratified_by_cancer"
    return plain_folds(samples, k, seed).select("sample_id", "fold", "cancer"), "shuffled_kfold"


def seeded_sample(samples: DataFrame, n: int | None, seed: int = 42, identifier: str = "sample_id") -> DataFrame:
    """The min(n, all) rows that come first by a seeded key, the same ones however the data is partitioned.

    Only identifiers, which are unique, are ranked; the rows themselves stay in their partitions.
    """
    if not n:
        return samples
    chosen = seeded_ordinals(samples.select(identifier), identifier, seed).filter(F.col("ordinal") <= n)
    return samples.join(chosen.select(identifier), identifier, "left_semi")
