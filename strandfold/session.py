"""Session helpers: where shared files go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandfold")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandfold-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/strandfold/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back.

    The result has no lineage and survives the loss of any executor, which makes it the right input
    for loops that scan the same table many times.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_by(df: DataFrame, partitions: int, column: str) -> DataFrame:
    """A checkpoint whose rows are partitioned by ``column``, so that later groups and joins by it do not move them.

    Spark forgets the partitioning of a checkpoint that was planned adaptively; hence that setting is off for this one
    job of the session, and then as it was.
    """
    conf, setting = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    shared_dir(df.sparkSession)
    before = conf.get(setting)
    conf.set(setting, "false")
    try:
        return df.repartition(partitions, column).checkpoint()
    finally:
        conf.set(setting, before)


def local_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A small driver-side table. Arrow makes it a local relation of known size, so joins with it are broadcast
    exactly when that size allows."""
    return spark.createDataFrame(pa.table(columns))
