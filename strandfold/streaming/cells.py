"""Samples that arrive as single cells: gathered per sample until complete or overdue, then rows in model order.

A sample's cells are held as two arrays of the model's width (sums and counts), so its state is bounded by the model and
not by how often a gene is measured. A sample is emitted as soon as every feature has a value, or when the watermark has passed
its first cell by ``wait``; gaps take the fill values. What comes for it afterwards is ignored; that mark is kept for another
``keep``, so state does not grow with the samples ever seen.

Defined cases: a cell delivered twice (equal ``cell_id``) counts once; different cells of one gene are averaged while the
sample is open; a cell without a value, or of a gene that the model lacks, starts the sample's time but fills nothing; a row
without a sample only moves the time; a cell that is later than the watermark is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from ..operators.align import _dictionary

GATHERED = "sample_id string, features array<double>, n_present int, complete boolean"
HELD = StructType([StructField("sums", BinaryType()), StructField("counts", BinaryType()), StructField("due", LongType()), StructField("done", BooleanType())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gatherer(StatefulProcessor):
    def __init__(self, fill: list[float], wait_ms: int, keep_ms: int):
        self.fill, self.wait_ms, self.keep_ms = fill, wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", HELD)
        self.base = np.array(self.fill, dtype="float64")

    def _read(self) -> tuple[np.ndarray, np.ndarray, int, bool] | None:
        if not self.held.exists():
            return None
        sums, counts, due, done = self.held.get()
        return np.frombuffer(sums, dtype="<f8").copy(), np.frombuffer(counts, dtype="<i4").copy(), due, done

    def _emit(self, sample: str, sums: np.ndarray, counts: np.ndarray, due: int) -> pd.DataFrame:
        """The finished row; of the state only the mark stays, and a timer that takes it away."""
        features = np.where(counts > 0, sums / np.maximum(counts, 1), self.base)
        self.held.update((b"", b"", due + self.keep_ms, True))
        self.handle.registerTimer(due + self.keep_ms)
        present = int((counts > 0).sum())
        return pd.DataFrame({"sample_id": [sample], "features": [features], "n_present": [present], "complete": [present == len(counts)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        width, known = len(self.base), self._read()
        if known and known[3]:
            return
        sums, counts, due, _ = known or (np.zeros(width), np.zeros(width, dtype="<i4"), None, False)
        first = None
        for batch in rows:
            first = min(x for x in (first, int(batch["at_ms"].min())) if x is not None)
            useful = batch[batch["idx"].notna() & batch["value"].notna()]
            where = useful["idx"].to_numpy(dtype="int64")
            np.add.at(sums, where, useful["value"].to_numpy(dtype="float64"))
            np.add.at(counts, where, 1)
        if (counts > 0).all():
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            yield self._emit(key[0], sums, counts, due if due is not None else first + self.wait_ms)
            return
        if due is None:
            due = first + self.wait_ms
            self.handle.registerTimer(due)
        self.held.update((sums.astype("<f8").tobytes(), counts.tobytes(), due, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._read()
        if known is None:
            return
        if known[3]:
            self.held.clear()
            return
        yield self._emit(key[0], *known[:3])

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB, which arbitrary state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def gather_samples(
    cells: DataFrame, features: list[str], means: np.ndarray, lateness: str = "1 hour", wait_seconds: int = 3600, keep_seconds: int = 86400
) -> DataFrame:
    """``sample_id, features, n_present, complete`` in append mode, from a stream of cell_id, ts, sample_id, gene, value.

    Start it inside ``keyed_state``.
    """
    timely = cells.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["cell_id"])
    indexed = timely.filter(F.col("sample_id").isNotNull()).join(_dictionary(cells, features), "gene", "left")
    sent = indexed.select("sample_id", "idx", F.col("value").cast("double").alias("value"), F.unix_millis("ts").alias("at_ms"))
    gatherer = Gatherer([float(v) for v in means], wait_seconds * 1000, keep_seconds * 1000)
    return sent.groupBy("sample_id").transformWithStateInPandas(gatherer, StructType.fromDDL(GATHERED), "Append", "EventTime")
