from pyspark.sql import functions as F

from strandfold.streaming.burden import windowed_burden
from strandfold.streaming.cells import gather_samples, keyed_state
from strandfold.streaming.run import drain, drain_updates

SCHEMA = "event_id bigint, ts timestamp, raw_sample string, variant_class string"


def test_late_and_repeated_events(spark, tmp_path):
    rows = [
        (1, "2024-01-01 10:00:00", "TCGA-AB-1-01", "Missense_Mutation"),
        (2, "2024-01-01 11:00:00", "TCGA-AB-1-01A-01R", "Splice_Site"),
        (2, "2024-01-01 11:00:00", "TCGA-AB-1-01A-01R", "Splice_Site"),
        (3, "2024-01-01 12:00:00", "TCGA-AB-2-01", "Silent"),
        (4, "2024-01-03 12:00:00", "TCGA-AB-2-01", "Nonsense_Mutation"),
    ]
    df = spark.createDataFrame(rows, "event_id bigint, t string, raw_sample string, variant_class string")
    path = str(tmp_path / "events")
    df.withColumn("ts", F.to_timestamp("t")).select("event_id", "ts", "raw_sample", "variant_class").write.parquet(path)
    counted = drain(windowed_burden(spark.readStream.schema(SCHEMA).parquet(path)), "counts")
    # The third day's window is still open, so append mode has not emitted it.
    assert [(r["sample_id"], r["tmb"]) for r in counted.collect()] == [("TCGA-AB-1-01A", 2)]
    # In update mode the open windows are there too.
    every = drain_updates(windowed_burden(spark.readStream.schema(SCHEMA).parquet(path)), "updates", ["window_start", "sample_id"], "tmb")
    assert sorted((r["sample_id"], r["tmb"]) for r in every.collect()) == [("TCGA-AB-1-01A", 2), ("TCGA-AB-2-01A", 1)]


CELLS = "cell_id bigint, ts timestamp, sample_id string, gene string, value double"


def test_samples_are_gathered_from_cells(spark, tmp_path):
    """Batch after batch: a file is a micro-batch, in the order of the files' times."""
    batches = [
        [(1, "10:00", "s1", "A", 1.0), (2, "10:01", "s1", "A", 3.0), (2, "10:01", "s1", "A", 3.0), (3, "10:02", "s2", "A", 5.0), (4, "10:02", "s3", "other", 9.0), (5, "10:03", "s4", "B", None)],
        [(6, "10:05", "s1", "B", 4.0), (7, "10:06", "s2", "A", 7.0)],
        # s1 is done: what comes now is ignored. The time moves on, so that the others are overdue.
        [(8, "10:10", "s1", "A", 100.0), (9, "15:00", None, None, None)],
        [(11, "15:01", "s5", "A", 1.0), (12, "15:01", "s5", "B", 2.0)],
        # Later than the watermark: dropped, and s2 is not opened again.
        [(10, "10:07", "s2", "B", 8.0), (13, "15:02", None, None, None)],
    ]
    path = tmp_path / "cells"
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "cell_id bigint, t string, sample_id string, gene string, value double")
        frame = frame.withColumn("ts", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t", F.lit(":00")))).select("cell_id", "ts", "sample_id", "gene", "value")
        frame.coalesce(1).write.parquet(str(path / f"batch={i}"))
    stream = spark.readStream.schema(CELLS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))
    with keyed_state(spark):
        found = drain(gather_samples(stream, ["A", "B"], [0.5, 0.25], lateness="10 minutes", wait_seconds=3600), "gathered").collect()
    got = {r["sample_id"]: (list(r["features"]), r["n_present"], r["complete"]) for r in found}
    assert len(found) == len(got)
    assert got == {"s1": ([2.0, 4.0], 2, True), "s2": ([6.0, 0.25], 1, False), "s3": ([0.5, 0.25], 0, False), "s4": ([0.5, 0.25], 0, False), "s5": ([1.0, 2.0], 2, True)}
