"""Helpers that several operators of this package use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A side of a join is broadcast up to so many rows of a few numbers each (about 32 MB); beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow and stored) marked for broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


#: A stored side of a join is broadcast up to so many bytes; beyond, it is shuffled.
BROADCAST_BYTES = 32 << 20
#: What a row of a broadcast table takes beside its values: key, pointers and padding.
ROW_BYTES = 48


def broadcast_if_bytes(df: DataFrame, size: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (stored) marked for broadcast if its rows, of ``size`` bytes each, fit; else as it is."""
    return F.broadcast(df) if (df.agg(F.sum(size + ROW_BYTES)).head()[0] or 0) <= most else df


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], dict | None], schema: T.StructType) -> DataFrame:
    """``work`` gives the columns of the result for one batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            if batch.num_rows and (columns := work(batch)) is not None:
                yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) and columns[f.name].type == f.type else pa.array(columns[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
