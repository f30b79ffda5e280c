"""Keep-first duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], pos: Sequence[str]) -> DataFrame:
    """The row of each key that comes first by ``pos``, whole.

    Done as a minimum over (pos, row) structs: it combines before the shuffle, so a key with very many
    copies sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in pos]
    first = F.min(F.struct(*pos, *rest)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*pos, *rest]])
