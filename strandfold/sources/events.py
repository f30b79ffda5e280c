"""Mutation event logs: column resolution by preference, and the reader."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted column names, the preferred one first.
SAMPLE_COLUMNS = ("sample", "Tumor_Sample_Barcode")
CLASS_COLUMNS = ("effect", "Variant_Classification")

# Variant classes that count as coding.
CODING_CLASSES = (
    "Missense_Mutation",
    "Frame_Shift_Del",
    "Frame_Shift_Ins",
    "Nonsense_Mutation",
    "Nonstop_Mutation",
    "In_Frame_Del",
    "In_Frame_Ins",
    "Translation_Start_Site",
    "Splice_Site",
)


def preferred_column(available: Iterable[str], choices: Iterable[str]) -> str:
    names = set(available)
    for choice in choices:
        if choice in names:
            return choice
    raise ValueError(f"Missing one of the columns {', '.join(choices)}; found {sorted(names)}.")


def resolve_events(events: DataFrame) -> DataFrame:
    """``raw_sample, variant_class`` from whichever of the known column names the log uses."""
    sample = preferred_column(events.columns, SAMPLE_COLUMNS)
    variant_class = preferred_column(events.columns, CLASS_COLUMNS)
    return events.select(F.col(sample).alias("raw_sample"), F.col(variant_class).alias("variant_class"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return resolve_events(spark.read.csv(path, sep="\t", header=True))
