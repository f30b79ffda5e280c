"""Token ids in packed rows: best-fit-decreasing by a segment tree over capacities.

Texts become token ids of a public byte-level vocabulary. A document of more than ``length`` tokens is split into
segments of exactly ``length`` and one shorter rest, so nothing is cut off. Segments are dealt in turn to pools of a
bounded number of tokens, whatever their ids or texts are (so which pool a segment is in depends on how the input is
partitioned), and each pool is packed on its own: segments by falling
length, each into the row whose free space is the smallest that still fits. The tree holds, for every free space from 0
to ``length``, how many open rows have it, and finds the smallest one that is large enough in log(length) steps.

A packed row is ``ids`` (little-endian 16-bit numbers, padded to ``length``), ``cu_seqlens`` (0 and the end of every
segment), ``position_resets`` (where positions start at 0 again) and the document and part number of every segment.

Defined cases: null and empty texts have no tokens and so no segment; ties in length go by document and part; rows that
repeat a document are packed each; a null id stays null; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LENGTH = 2048
#: Not used by the vocabulary; it fills rows up.
PAD = 50256
#: Text bytes of one pool: some two thousand rows, a few megabytes of ids.
POOL_BYTES = 8 << 20
#: Fixed value: how the vocabulary's authors cut text before merging bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What the remembered ids of one task may take, and what one of them takes beside its bytes.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 200
#: A text of more characters is not remembered, and white space of more is taken out of a text.
LONG_CHUNK = 64
#: Characters that are given to the vocabulary at once, about.
PIECE = 1 << 16
#: What PATTERN takes for white space.
BLANK = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANK = re.compile(f"[{BLANK}]{{{LONG_CHUNK + 1},}}")
#: PATTERN cuts here whatever comes before: white space never ends a piece of other characters.
BREAK = re.compile(f"(?<=[^{BLANK}])(?=[{BLANK}])")
ID = "<u2"


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("packed", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """The text in parts that PATTERN would cut too, and whether one is a long run of white space."""
    at = 0
    for run in LONG_BLANK.finditer(text):
        yield from ((part, False) for part in _bounded(text[at : run.start()]))
        # The last one of a run goes with what follows.
        at = run.end() - (run.end() < len(text))
        yield text[run.start() : at], True
    yield from ((part, False) for part in _bounded(text[at:]))


def _bounded(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE and (found := BREAK.search(text, at + PIECE)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Encoder:
    """Ids of texts; short ones repeat, so theirs are remembered, in a bounded number of bytes."""

    def __init__(self, vocabulary: bytes):
        self.encoding, self.known, self.held = _encoder(vocabulary), {}, 0

    def _whole(self, text: str) -> np.ndarray:
        parts = []
        for piece, blank in _pieces(text):
            # White space alone is one piece of PATTERN, which would try it from every place of a long run.
            ids = self.encoding._core_bpe.encode_single_piece(piece.encode()) if blank else self.encoding.encode_ordinary(piece)
            parts.append(np.array(ids, dtype=ID))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def encode(self, text: str) -> np.ndarray:
        if len(text) > LONG_CHUNK:
            return self._whole(text)
        ids = self.known.get(text)
        if ids is None:
            ids = self._whole(text)
            self.held += ENTRY_BYTES + ids.nbytes + len(text)
            if self.held > CACHE_BYTES:
                self.known.clear()
                self.held = ENTRY_BYTES + ids.nbytes + len(text)
            self.known[text] = ids
        return ids


def decode(ids: np.ndarray, vocabulary: bytes) -> str:
    return _encoder(vocabulary).decode_bytes(ids.tolist()).decode()


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Capacities:
    """Counts of open rows by free space, in a segment tree."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, space: int, change: int) -> None:
        i = space + self.size
        while i:
            self.tree[i] += change
            i >>= 1

    def put(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        self._add(space, 1)

    def take(self, needed: int) -> tuple[int, int] | None:
        """The row opened last among those of the smallest free space that is at least ``needed``."""
        i, tree = needed + self.size, self.tree
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        space = i - self.size
        self._add(space, -1)
        return space, self.rows[space].pop()


def best_fit_decreasing(lengths: Sequence[int], length: int) -> list[int]:
    """The row of each item; ``lengths`` falls and none exceeds ``length``."""
    open_, rows, count = Capacities(length), [], 0
    for n in lengths:
        found = open_.take(n) if n < length else None
        space, row = found if found else (length, count)
        count += found is None
        rows.append(row)
        if space > n:
            open_.put(space - n, row)
    return rows


SEGMENTS = T.StructType([
    T.StructField("pool", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("ids", T.BinaryType()),
])


def segments(docs: DataFrame, pools: int, length: int = LENGTH, vocabulary: str = VOCABULARY, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``pool, doc_id, part, ids``: the parts of a document, in order, are its tokens."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, turn = Encoder(ranks.value), TaskContext.get().partitionId() * 7919
        for batch in batches:
            out, size = ([], [], [], []), 0
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encoder.encode(t.as_py() or "")
                for part, at in enumerate(range(0, len(ids), length)):
                    for column, value in zip(out, (turn % pools, d, part, ids[at : at + length].tobytes()), strict=True):
                        column.append(value)
                    turn, size = turn + 1, size + 2 * length
                    if size > 16 << 20:
                        yield _segment_batch(out)
                        out, size = ([], [], [], []), 0
            yield _segment_batch(out)

    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SEGMENTS)


def _segment_batch(columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=SEGMENTS.names)


PACKED = T.StructType([
    T.StructField("pool", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("position_resets", T.ArrayType(T.IntegerType())),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("parts", T.ArrayType(T.IntegerType())),
])


def pool_count(docs: DataFrame, text: str = "text", pool_bytes: int = POOL_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    return max(1, -(-total // pool_bytes))


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, doc: str = "doc_id", text: str = "text", pool_bytes: int = POOL_BYTES) -> DataFrame:
    """The packed rows of all documents."""
    cut = segments(docs, pool_count(docs, text, pool_bytes), length, vocabulary, doc, text)

    def run(pool: pa.Table) -> pa.Table:
        sizes = np.array([len(x.as_buffer()) // 2 for x in pool.column("ids")], dtype=np.int64)
        ids = [x if x is not None else -1 for x in pool.column("doc_id").to_pylist()]
        order = np.lexsort((pool.column("part").to_numpy(), np.array(ids), -sizes))
        rows: dict[int, list[int]] = {}
        for i, row in zip(order.tolist(), best_fit_decreasing(sizes[order].tolist(), length), strict=True):
            rows.setdefault(row, []).append(i)
        docs_, parts, tokens = pool.column("doc_id").to_pylist(), pool.column("part").to_pylist(), pool.column("ids")
        out = {n: [] for n in PACKED.names}
        for row, members in rows.items():
            ends = np.cumsum(sizes[members])
            matrix = np.full(length, PAD, dtype=ID)
            matrix[: ends[-1]] = np.frombuffer(b"".join(tokens[i].as_py() for i in members), dtype=ID)
            values = (pool.column("pool")[0].as_py(), row, int(ends[-1]), matrix.tobytes(), [0, *ends.tolist()], [0, *ends[:-1].tolist()], [docs_[i] for i in members], [parts[i] for i in members])
            for n, v in zip(PACKED.names, values, strict=True):
                out[n].append(v)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=PACKED.names)

    return cut.groupBy("pool").applyInArrow(run, PACKED)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """The packed rows as Parquet; ``ids`` of all rows of a file, one after the other, are its id matrix."""
    pack(docs, **options).write.parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Packed rows with ``input_ids`` and ``position_ids`` spelled out; positions start at 0 in every segment."""
    packed = spark.read.parquet(path)
    at = F.transform(F.sequence(F.lit(0), F.col("n_tokens") - 1), lambda i: i - F.array_max(F.filter("position_resets", lambda r: r <= i)))
    byte = lambda i: F.conv(F.hex(F.substring("ids", i, 1)), 16, 10).cast("int")
    ids = F.transform(F.sequence(F.lit(0), F.col("n_tokens") - 1), lambda i: byte(2 * i + 1) + 256 * byte(2 * i + 2))
    return packed.withColumn("input_ids", ids).withColumn("position_ids", at)
