"""``spark.read.format("wide")`` and ``df.write.format("wide")``: wide delimited matrices as a data source.

Reading gives ``file, row_pos, row_id, column_pos, column_id, text``, a row per cell. Plain files are cut into byte ranges,
one task each; a compressed file is one. Equality and IN filters on ``row_id`` and ``column_id`` are pushed down: lines of
other rows are not cut into fields, and of a line that is read only the fields of wanted columns are taken. Nothing is
stored in between.

Writing takes one text column, a line a row, named by the header line (``export.wide_lines``). Tasks write below a staging
folder beside the path; when all have succeeded, that folder is moved to the path in one step. If any fails, the staging
folder goes and the path has never existed.

Files are reached by pyarrow's file systems (local or any URI that they know); where only Spark reaches a store, use
``matrix.read_wide`` and ``export.write_wide``. A quoted field may hold the separator and doubled quotes, but no line break.
"""

from __future__ import annotations

import csv
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.values import number
from .export import wide_lines

CELLS = "file string, row_pos bigint, row_id string, column_pos int, column_id string, text string"
SPLIT_BYTES = 32 << 20
#: Cells that are handed over together.
BATCH_CELLS = 1 << 16


def reached(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def data_files(path: str) -> list[pafs.FileInfo]:
    """Files of a path that are not hidden, by name."""
    system, inside = reached(path)
    found = system.get_file_info(inside)
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    listed = system.get_file_info(pafs.FileSelector(inside)) if found.type == pafs.FileType.Directory else [found]
    return sorted((f for f in listed if f.is_file and f.base_name[0] not in "._" and f.size), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [start, end); all lines without an end."""

    file: str
    start: int
    end: int | None


def split_fields(line: str, sep: str) -> list[str]:
    return next(csv.reader([line], delimiter=sep)) if '"' in line else line.split(sep)


def pick_fields(line: bytes, sep: str, places: list[int]) -> list[str | None]:
    """The fields at some places (falling places are not allowed); None beyond the line's end."""
    if b'"' in line:
        fields = split_fields(line.decode(), sep)
        return [fields[i] if i < len(fields) else None for i in places]
    cuts = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == ord(sep))
    out = []
    for i in places:
        if i > len(cuts):
            out.append(None)
        else:
            out.append(line[int(cuts[i - 1]) + 1 if i else 0 : int(cuts[i]) if i < len(cuts) else len(line)].decode())
    return out


class WideReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sep = options["path"], options.get("sep", "\t")
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.rows: set[str] | None = None
        self.columns: set[str] | None = None
        #: Fields taken out of lines by this copy of the reader.
        self.parsed = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what names rows and columns; give the others back."""
        for one in filters:
            values = {one.value} if isinstance(one, EqualTo) else set(one.value) if isinstance(one, In) else None
            if values is not None and one.attribute == ("row_id",):
                self.rows = values if self.rows is None else self.rows & values
            elif values is not None and one.attribute == ("column_id",):
                self.columns = values if self.columns is None else self.columns & values
            else:
                yield one

    def partitions(self) -> list[Range]:
        out = []
        for f in data_files(self.path):
            if f.extension in ("gz", "bz2", "zst", "lz4"):
                out.append(Range(f.path, 0, None))
            else:
                out += [Range(f.path, at, min(at + self.split_bytes, f.size)) for at in range(0, f.size, self.split_bytes)]
        return out

    def _lines(self, part: Range) -> Iterator[tuple[int, bytes]]:
        """Lines that begin inside the range, with their place in the file; the header line comes first in any case."""
        system, _ = reached(self.path)
        if part.end is None:
            with system.open_input_stream(part.file, compression="detect") as raw:
                at = 0
                for line in _stream_lines(raw):
                    yield at, line
                    at += len(line)
            return
        with system.open_input_file(part.file) as raw:
            head = next(_stream_lines(raw))
            yield 0, head
            at = max(part.start, len(head))
            if at >= part.end:
                return
            raw.seek(at - 1)
            lines = _stream_lines(raw)
            at += len(next(lines)) - 1  # what is left of the line before, or just its end
            for line in lines:
                if at >= part.end:
                    return
                yield at, line
                at += len(line)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        lines = self._lines(part)
        names = split_fields(next(lines)[1].rstrip(b"\r\n").decode(), self.sep)
        places = [i for i, n in enumerate(names) if i and (self.columns is None or n in self.columns)]
        every, held, cells = len(places) == len(names) - 1, [], 0
        for at, line in lines:
            line = line.rstrip(b"\r\n")
            if not line or not places:
                continue
            if self.rows is not None and pick_first(line, self.sep) not in self.rows:
                continue
            fields = split_fields(line.decode(), self.sep) if every else pick_fields(line, self.sep, [0, *places])
            self.parsed += len(fields) - 1
            held.append((at, fields))
            cells += len(fields) - 1
            if cells >= BATCH_CELLS:
                yield self._batch(part.file, names, places, held)
                held, cells = [], 0
        if held:
            yield self._batch(part.file, names, places, held)

    def _batch(self, file: str, names: list[str], places: list[int], held: list[tuple[int, list]]) -> pa.RecordBatch:
        at, ids, where, texts = [], [], [], []
        for pos, fields in held:
            own = [(i, x) for i, x in zip(places, fields[1:], strict=False) if x is not None]
            at += [pos] * len(own)
            ids += [fields[0]] * len(own)
            where += [i for i, _ in own]
            texts += [x for _, x in own]
        columns = [pa.array([file] * len(at)), pa.array(at, pa.int64()), pa.array(ids, pa.string()), pa.array(where, pa.int32()), pa.array([names[i] for i in where], pa.string()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["file", "row_pos", "row_id", "column_pos", "column_id", "text"])


def pick_first(line: bytes, sep: str) -> str:
    return split_fields(line.decode(), sep)[0] if line[:1] == b'"' else line.split(sep.encode(), 1)[0].decode()


def _stream_lines(raw, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines with their ends; memory is a piece and the longest line."""
    rest = b""
    while piece := raw.read(size):
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            yield line + b"\n"
    if rest:
        yield rest


@dataclass
class Written(WriterCommitMessage):
    file: str
    lines: int


class WideWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if len(schema) != 1 or overwrite:
            raise ValueError("A wide matrix is one column of lines, written where nothing is.")
        self.path, self.header = options["path"].rstrip("/"), schema[0].name
        self.ending = {"gzip": ".csv.gz", "none": ".csv"}[options.get("compression", "none")]
        system, inside = reached(self.path)
        if system.get_file_info(inside).type != pafs.FileType.NotFound:
            raise FileExistsError(self.path)
        parent, _, name = inside.rpartition("/")
        self.staging = f"{parent}/.{name}.{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, _ = reached(self.path)
        context = TaskContext.get()
        # An attempt has a file of its own, so a second one never meets what a first one left.
        file, lines = f"part-{context.partitionId():05d}-{context.taskAttemptId()}{self.ending}", 0
        system.create_dir(self.staging, recursive=True)
        with system.open_output_stream(f"{self.staging}/{file}", compression="detect") as out:
            out.write(self.header.encode() + b"\n")
            for batch in batches:
                lines += batch.num_rows
                out.write("".join(f"{x}\n" for x in batch.column(0).to_pylist()).encode())
        return Written(file, lines)

    def commit(self, messages: list[Written | None]) -> None:
        """Drop files of attempts that did not count, then publish all others at once."""
        system, inside = reached(self.path)
        system.create_dir(self.staging, recursive=True)
        kept = {m.file for m in messages if m is not None}
        for f in system.get_file_info(pafs.FileSelector(self.staging)):
            if f.base_name not in kept:
                system.delete_file(f.path)
        system.move(self.staging, inside)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = reached(self.path)
        if system.get_file_info(self.staging).type == pafs.FileType.Directory:
            system.delete_dir(self.staging)


class WideSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wide"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> WideReader:
        return WideReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WideWriter:
        return WideWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WideSource)


def read_wide_source(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``file, row_pos, row_id, column_pos, column_id, value``; text that is not a number is NULL."""
    register(spark)
    cells = spark.read.format("wide").option("sep", sep).load(path)
    return cells.withColumn("value", number(F.col("text"))).drop("text")


def publish_wide(cells: DataFrame, samples: DataFrame, features: list[str], path: str, sep: str = "\t", compression: str = "none", fill: float | None = None) -> None:
    """Samples in rows, features in columns, all or nothing."""
    register(cells.sparkSession)
    wide_lines(cells, samples, features, sep, fill).write.format("wide").option("compression", compression).mode("append").save(path)
