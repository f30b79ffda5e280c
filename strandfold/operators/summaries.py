"""Cohort statistics as a table of partial states, so that a new cohort is added without reading the old ones.

A state is what one part of the data (a cohort, or any piece of one) says: per gene the count, mean, sum of squared
deviations and range of its finite cells, and per target its positive samples beside the part's number of samples. States merge
exactly: the merged mean is the weighted mean, and the merged squares are those of the parts and those of their means about it,
so nothing is lost by subtracting large numbers. However a data set is cut, merged states say what one pass over it says.

Defined cases: a cell that is null, NaN or infinite counts nowhere; a gene without other cells is known, with a count
of 0 and no mean; a null cohort is a part of its own, named ''; a part without samples or labels changes nothing; adding a
part whose name is there already is an error, so that nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import is_finite
from .cohort import scalar

GENES = "part string, gene string, n bigint, mean double, squares double, low double, high double"
TARGETS = "part string, target string, n_positive bigint"
SIZES = "part string, n_samples bigint"
TABLES = {"genes": GENES, "targets": TARGETS, "sizes": SIZES}


def gene_states(expression: DataFrame, part: str | None = None) -> DataFrame:
    """Per gene, and per value of the column ``part`` if there is one: n, mean, squares, low, high."""
    name = F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit("")
    cells = expression.select(name.alias("part"), "gene", F.when(is_finite(F.col("value")), F.col("value").cast("double")).alias("value"))
    return cells.groupBy("part", "gene").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("squares"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )


def merge_genes(states: DataFrame, *by: str) -> DataFrame:
    """One state per gene (and ``by``), with ``parts``, the number of parts that have cells of it.

    Means are merged first and joined back, so a gene may have states in any number of parts.
    """
    keys = ["gene", *by]
    totals = states.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.count_if(F.col("n") > 0).alias("parts"),
    )
    apart = F.col("squares") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    squares = states.join(totals.select(*keys, F.col("mean").alias("_mean")), keys).groupBy(*keys).agg(F.sum(apart).alias("squares"))
    return totals.join(squares, keys).select(*keys, "n", "mean", "squares", "low", "high", "parts")


def stats_from_states(states: DataFrame) -> DataFrame:
    """``gene, n, parts, mean, std, scale``, as ``feature_stats`` has them."""
    std = F.sqrt(F.try_divide(F.col("squares"), F.col("n")))
    merged = merge_genes(states).withColumn("std", std)
    return merged.select("gene", "n", "parts", "mean", "std", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)).alias("scale"))


def target_states(mutations: DataFrame, samples: DataFrame, part: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Positive samples per part and target, and samples per part. Labels of unknown samples do not count."""
    name = F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit("")
    known = samples.select("sample_id", name.alias("part"))
    called = mutations.groupBy("sample_id", "target").agg(F.max("label").alias("label")).join(known, "sample_id")
    positives = called.groupBy("part", "target").agg(F.sum(F.col("label").cast("bigint")).alias("n_positive"))
    return positives, known.groupBy("part").agg(F.count(F.lit(1)).alias("n_samples"))


def prevalence_from_states(targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """``target, n_positive, n_samples, prevalence``, as ``targets.prevalence`` has them."""
    merged = targets.groupBy("target").agg(F.sum("n_positive").alias("n_positive")).withColumn("n_samples", scalar(sizes, F.sum("n_samples")))
    return merged.withColumn("prevalence", F.try_divide(F.col("n_positive"), F.col("n_samples")))


class StateTable:
    """States on shared storage, a folder per part: ``add`` reads the new part only, the others read states only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, part: str, expression: DataFrame, mutations: DataFrame | None = None, samples: DataFrame | None = None) -> None:
        tables = {"genes": gene_states(expression)}
        if samples is not None:
            labels = mutations if mutations is not None else self.spark.createDataFrame([], "sample_id string, target string, label int")
            tables["targets"], tables["sizes"] = target_states(labels, samples)
        # The genes come last: a part whose folder of genes is there is complete.
        for name in ("sizes", "targets", "genes"):
            if name in tables:
                mode = "errorifexists" if name == "genes" else "overwrite"
                tables[name].withColumn("part", F.lit(part)).select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.mode(mode).parquet(f"{self.path}/{name}/{self._folder(part)}")

    @staticmethod
    def _folder(part: str) -> str:
        return "p" + part.encode().hex()

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")

    def feature_stats(self) -> DataFrame:
        return stats_from_states(self._read("genes"))

    def prevalence(self) -> DataFrame:
        done = self._read("genes").select("part").distinct()
        return prevalence_from_states(self._read("targets").join(done, "part", "left_semi"), self._read("sizes").join(done, "part", "left_semi"))
