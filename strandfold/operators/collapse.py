"""Annotation lookup, collapse of repeated symbols, burden counting."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import canonical_sample_id, probe_symbol, strip_version
from ..functions.values import burden_log2
from ..sources.events import CODING_CLASSES

COLLAPSES = ("mean", "sum", "first")


def annotate(cells: DataFrame, annotation: DataFrame, coding_only: bool = True) -> DataFrame:
    """Replace ``gene_id`` by its ``gene`` symbol; unmapped and (optionally) non-coding genes drop out.

    The annotation is filtered before the join. No hint: it is broadcast when its measured size allows.
    """
    known = annotation.filter(F.col("symbol").isNotNull())
    if coding_only:
        known = known.filter(F.col("biotype") == "protein_coding")
    known = known.select("gene_id", F.col("symbol").alias("gene"))
    return cells.withColumn("gene_id", strip_version(F.col("gene_id"))).join(known, "gene_id")


def collapse(cells: DataFrame, how: str = "mean", pos: str = "gene_pos") -> DataFrame:
    """One value per (sample, gene). ``mean`` skips missing cells; ``sum`` of nothing is 0; ``first`` goes by ``pos``."""
    if how == "mean":
        value = F.avg("value")
    elif how == "sum":
        value = F.coalesce(F.sum("value"), F.lit(0.0))
    elif how == "first":
        value = F.min_by("value", pos)
    else:
        raise ValueError(f"collapse must be one of: {', '.join(COLLAPSES)}")
    return cells.groupBy("sample_id", "gene").agg(value.alias("value"))


def probes_to_genes(cells: DataFrame, platform: DataFrame) -> DataFrame:
    """Probe values to gene values: first listed symbol, mean per symbol. ``platform``: probe, symbols."""
    named = platform.select("probe", probe_symbol(F.col("symbols")).alias("gene")).filter(F.col("gene").isNotNull())
    return collapse(cells.join(named, "probe"), "mean")


def burden_counts(events: DataFrame, coding: Iterable[str] = CODING_CLASSES) -> DataFrame:
    """Coding events per canonical sample, with the log2 scale. ``events``: raw_sample, variant_class."""
    counted = (
        events.filter(F.col("variant_class").isin(*coding))
        .groupBy(canonical_sample_id(F.col("raw_sample")).alias("sample_id"))
        .agg(F.count(F.lit(1)).alias("tmb"))
    )
    return counted.withColumn("tmb_log2", burden_log2(F.col("tmb")))
