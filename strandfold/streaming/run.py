"""Drive a streaming plan over what is available now, into a table on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.multilabel import MultiLabelModel
from ..session import scratch_path


def score_stream(model: MultiLabelModel, dense: DataFrame) -> DataFrame:
    """Scores of a stream of dense rows (``sample_id, features``): stateless, append mode."""
    return model.score_dense(dense)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process the available input to completion and read the sink back."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", f"{out}_state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, name: str, keys: list[str], value: str) -> DataFrame:
    """Process the available input in update mode: the last state of every key, open windows included.

    Every micro-batch overwrites its own folder, so a repeated batch changes nothing. ``value`` only grows.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(store)
        .outputMode("update")
        .option("checkpointLocation", f"{out}_state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    updates = spark.read.schema(stream.schema).parquet(out)
    return updates.groupBy(*keys).agg(F.max(value).alias(value))
