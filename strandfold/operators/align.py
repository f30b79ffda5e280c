"""Feature statistics, alignment of new samples to a model's features, dense rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import local_table



def feature_stats(expression: DataFrame) -> DataFrame:
    """Per gene: mean (the fill value), population deviation, and the scale, which is 1 for a constant gene."""
    stats = expression.groupBy("gene").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return stats.withColumn("scale", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)))


def standardise(expression: DataFrame) -> DataFrame:
    """Add ``z``, the value in units of its gene's population deviation."""
    stats = feature_stats(expression).select("gene", "mean", "scale")
    return expression.join(stats, "gene").select(
        "sample_id", "gene", "value", ((F.col("value") - F.col("mean")) / F.col("scale")).alias("z")
    )


def feature_overlap(expression: DataFrame, features: list[str]) -> float:
    """Share of the wanted features that the data has at all."""
    wanted = _dictionary(expression, features)
    shared = wanted.join(expression.select("gene").distinct(), "gene", "left_semi").count()
    return shared / max(len(features), 1)


def check_overlap(expression: DataFrame, features: list[str], min_overlap: float) -> float:
    overlap = feature_overlap(expression, features)
    if overlap < min_overlap:
        raise ValueError(
            f"Only {overlap:.1%} of the model's features are in the data (feature overlap), {min_overlap:.1%} are needed; "
            "check quantity, transform and gene symbols."
        )
    return overlap


def _dictionary(df: DataFrame, features: list[str]) -> DataFrame:
    idx = pa.array(range(len(features)), pa.int32())
    return local_table(df.sparkSession, idx=idx, gene=pa.array(features, pa.string()))


def with_index(cells: DataFrame, features: list[str], key: str = "gene") -> DataFrame:
    """``sample_id, idx, value`` for the listed features only."""
    dictionary = _dictionary(cells, features).withColumnRenamed("gene", key)
    return cells.join(dictionary, key).select("sample_id", "idx", "value")


def dense_rows(
    cells: DataFrame, samples: DataFrame, width: int, fill: np.ndarray | float | None = None, out: str = "features"
) -> DataFrame:
    """One array per sample from ``sample_id, idx, value``; absent and missing cells take the fill value.

    A sample's cells are at most ``width`` many, so gathering them is bounded. Only present cells are
    shuffled: the samples x features product exists nowhere but inside the arrays.
    """
    base = np.full(width, np.nan) if fill is None else np.broadcast_to(np.asarray(fill, dtype="float64"), (width,))
    base = base.copy()

    @F.pandas_udf("array<double>")
    def scatter(idx: pd.Series, value: pd.Series) -> pd.Series:
        rows = []
        for where, what in zip(idx, value):
            row = base.copy()
            if where is not None and len(where):
                numbers = np.asarray(what, dtype="float64")
                present = ~np.isnan(numbers)
                row[np.asarray(where)[present]] = numbers[present]
            rows.append(row)
        return pd.Series(rows)

    packed = cells.groupBy("sample_id").agg(F.collect_list(F.struct("idx", "value")).alias("_cells"))
    dense = samples.join(packed, "sample_id", "left").withColumn(out, scatter("_cells.idx", "_cells.value")).drop("_cells")
    if fill is None:
        dense = dense.withColumn(out, F.transform(out, lambda x: F.when(~F.isnan(x), x)))
    return dense


def align_features(
    expression: DataFrame, samples: DataFrame, features: list[str], means: np.ndarray, min_overlap: float = 0.8
) -> tuple[DataFrame, float]:
    """Dense rows in model order: repeated genes averaged, extra genes dropped, gaps filled with training means.

    Averaging combines before its shuffle and leaves a sample at most one cell per feature, so the gathering
    that follows is bounded even for a sample that is repeated very often.
    """
    overlap = check_overlap(expression, features, min_overlap)
    wanted = expression.join(_dictionary(expression, features), "gene")
    averaged = wanted.groupBy("sample_id", "idx").agg(F.avg("value").alias("value"))
    return dense_rows(averaged, samples, len(features), means), overlap


def long_rows(dense: DataFrame, names: list[str], array: str = "features", name: str = "gene", value: str = "value") -> DataFrame:
    """Dense arrays back to one row per (sample, name)."""
    dictionary = _dictionary(dense, names).withColumnRenamed("gene", name)
    return (
        dense.select("sample_id", F.posexplode(array).alias("idx", value)).join(dictionary, "idx").drop("idx")
    )
