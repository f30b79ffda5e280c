"""Burden counting on an event stream."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import canonical_sample_id
from ..sources.events import CODING_CLASSES


def windowed_burden(
    events: DataFrame, coding: Iterable[str] = CODING_CLASSES, window: str = "1 day", lateness: str = "1 hour"
) -> DataFrame:
    """Coding events per window and canonical sample: ``window_start, sample_id, tmb``.

    ``events``: event_id, ts (timestamp), raw_sample, variant_class. An event that is delivered twice counts
    once. Append mode emits a window when the watermark has passed its end; update mode emits every change, so a bounded
    run (``drain_updates``) also has the windows that are still open. State is bounded by the watermark, and counts
    combine before the shuffle.
    """
    coding_only = events.filter(F.col("variant_class").isin(*coding))
    once = coding_only.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return (
        once.groupBy(F.window("ts", window).alias("w"), canonical_sample_id(F.col("raw_sample")).alias("sample_id"))
        .agg(F.count(F.lit(1)).alias("tmb"))
        .select(F.col("w.start").alias("window_start"), "sample_id", "tmb")
    )
