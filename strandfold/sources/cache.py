"""Prepared cohorts on shared storage, keyed by everything that shaped them."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from ..operators.cohort import Cohort
from .export import read_metadata


def settings_digest(settings: dict) -> str:
    """First 16 hex digits of the SHA-256 of the settings, independent of key order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode("utf-8")).hexdigest()[:16]


def prepared_path(directory: str, settings: dict) -> str:
    return f"{directory.rstrip('/')}/prepared_{settings_digest(settings)}"


def write_prepared(cohort: Cohort, path: str, metadata: dict) -> None:
    """Expression is laid out by cohort so that later reads prune; a hot cohort is spread over many files."""
    spark = cohort.samples.sparkSession
    cohort.samples.write.mode("overwrite").parquet(f"{path}/samples")
    located = cohort.expression.join(cohort.samples.select("sample_id", "cancer"), "sample_id")
    # Ranges follow the size of the data, so a cohort has as many files as it needs.
    located.repartitionByRange("cancer", "sample_id").write.mode("overwrite").partitionBy("cancer").parquet(
        f"{path}/expression"
    )
    for name in ("mutations", "tmb"):
        table = getattr(cohort, name)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    text = json.dumps({**metadata, "tables": [n for n in ("mutations", "tmb") if getattr(cohort, n) is not None]})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def read_prepared(spark: SparkSession, path: str) -> Cohort | None:
    """The stored cohort, or None where nothing complete is stored."""
    try:
        metadata = read_metadata(spark, path)
    except AnalysisException:
        return None
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in metadata["tables"]}
    return Cohort(
        samples=spark.read.parquet(f"{path}/samples"),
        expression=spark.read.parquet(f"{path}/expression").select("sample_id", "gene", "value"),
        mutations=tables.get("mutations"),
        tmb=tables.get("tmb"),
    )


def cached_cohort(spark: SparkSession, directory: str, settings: dict, build) -> Cohort:
    """Reuse the cohort stored for these settings, or build, store and reread it."""
    path = prepared_path(directory, settings)
    stored = read_prepared(spark, path)
    if stored is None:
        write_prepared(build(), path, {"settings": settings})
        stored = read_prepared(spark, path)
    return stored
