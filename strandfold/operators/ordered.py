"""Running totals and ordinals that never put a whole group into one task.

A plain window over a group sorts all of the group's rows in one task. Here the rows of a group are first
cut into value ranges; the ranges are summed, the (few) range sums are accumulated, and only the rows of
one range meet in a window. Callers aggregate equal values first, so a heavily tied value is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

BEFORE = (W.unboundedPreceding, -1)


def totals_before(
    df: DataFrame, group: Sequence[str], value: str, measures: Sequence[str], descending: bool = False, ranges: int | None = None
) -> DataFrame:
    """Add ``<m>_before``, the total of ``m`` over the strictly preceding values of the group, and ``<m>_all``.

    ``df`` must hold one row per (group, value). Spark's range partitioner cuts the rows, ordered by group and
    value, into even pieces, so a large group has many pieces and many small groups share one. The pieces are
    stored with their number, since both passes below must see the same cuts.
    """
    group = list(group)
    pieces = df.repartitionByRange(ranges, *group, value) if ranges else df.repartitionByRange(*group, value)
    ranged = materialise(pieces.withColumn("_range", F.spark_partition_id()), "ranges")

    def order(name: str) -> Column:
        return F.desc(name) if descending else F.asc(name)

    # One row per group and piece.
    over_ranges = W.partitionBy(*group).orderBy(order("_range")).rowsBetween(*BEFORE)
    sums = ranged.groupBy(*group, "_range").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = sums.select(
        *group,
        "_range",
        *[F.coalesce(F.sum(m).over(over_ranges), F.lit(0)).alias(f"_{m}_offset") for m in measures],
        *[F.sum(m).over(W.partitionBy(*group)).alias(f"{m}_all") for m in measures],
    )
    within = W.partitionBy(*group, "_range").orderBy(order(value)).rowsBetween(*BEFORE)
    joined = ranged.join(offsets, [*group, "_range"])
    for m in measures:
        joined = joined.withColumn(
            f"{m}_before", F.coalesce(F.sum(m).over(within), F.lit(0)) + F.col(f"_{m}_offset")
        )
    return joined.drop("_range", *[f"_{m}_offset" for m in measures])


def average_ranks(df: DataFrame, group: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """One row per (group, value): average 1-based rank ``rank``, copies ``n`` and group size ``n_all``."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = totals_before(counted, group, value, ["n"], ranges=ranges)
    return ranked.withColumn("rank", F.col("n_before") + (F.col("n") + 1) / F.lit(2.0))


def seeded_key(identifier: Column, seed: int) -> Column:
    """A reproducible, uniformly spread sort key."""
    return F.md5(F.concat(identifier.cast("string"), F.lit(f":{seed}")))


def seeded_ordinals(df: DataFrame, identifier: str, seed: int, group: str | None = None) -> DataFrame:
    """Add ``ordinal`` (1-based, by seeded key) and ``total``, within ``group`` or overall.

    The key is uniform, so its leading digits are ready-made equal ranges: 4096 of them.
    """
    keyed = df.withColumn("_key", seeded_key(F.col(identifier), seed)).withColumn(
        "_range", F.substring("_key", 1, 3)
    )
    keyed = keyed.withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit(""))
    counts = keyed.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_group",
        "_range",
        F.coalesce(
            F.sum("_n").over(W.partitionBy("_group").orderBy("_range").rowsBetween(*BEFORE)), F.lit(0)
        ).alias("_offset"),
        F.sum("_n").over(W.partitionBy("_group")).alias("total"),
    )
    within = W.partitionBy("_group", "_range").orderBy("_key", identifier)
    return (
        keyed.join(offsets, ["_group", "_range"])
        .withColumn("ordinal", F.col("_offset") + F.row_number().over(within).cast("bigint"))
        .drop("_group", "_range", "_key", "_offset")
    )
