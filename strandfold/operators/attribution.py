"""Summaries of attribution tables (``sample_id, feature, shap_value``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def attribution_summary(values: DataFrame, target: str, method: str) -> DataFrame:
    """Mean absolute and mean signed value per feature, ranked; ties by feature name.

    The ranking window runs over one row per feature.
    """
    means = values.groupBy("feature").agg(
        F.avg(F.abs("shap_value")).alias("mean_abs_shap"), F.avg("shap_value").alias("mean_shap")
    )
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs_shap"), F.asc("feature"))
    return means.select(
        F.lit(target).alias("target"),
        F.lit(method).alias("method"),
        F.row_number().over(order).cast("bigint").alias("rank"),
        "feature",
        "mean_abs_shap",
        "mean_shap",
    )


def top_attributions(values: DataFrame, summary: DataFrame, expression: DataFrame, n: int = 20) -> DataFrame:
    """Per-sample values of the n highest-ranked features, with the expression they were computed on."""
    best = summary.filter(F.col("rank") <= n).select("target", "method", "feature")
    chosen = values.join(best, "feature")
    shown = expression.select("sample_id", F.col("gene").alias("feature"), F.col("value").alias("expression_value"))
    return chosen.join(shown, ["sample_id", "feature"], "left").select(
        "sample_id", "target", "method", "feature", "shap_value", "expression_value"
    )
