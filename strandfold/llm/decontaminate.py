"""Benchmark decontamination: a broadcast set of benchmark windows against every word window of the documents.

A benchmark item is cut into windows of ``width`` words (a shorter item is one window). Their hashes are broadcast,
every document window is looked up, hits are compared word for word, and what is hit is marked, cut out or dropped.
The benchmark is broadcast in blocks of at most ``block_bytes`` of normalised text, so a benchmark of any size is
checked in as many passes over the documents as it has blocks.

Defined cases: a null or empty text has no words and no hits; an item without words never occurs; repeated items and
repeated documents are each reported; an empty benchmark hits nothing; a null item id counts as no item but its
windows hit. Columns of the input with the names of added columns are replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import arrow_map, without
from .words import ALPHANUMERIC, covered, slices, split_words

WIDTH = 10
BLOCK_BYTES = 16 << 20
#: Words of an item that are kept together; pieces overlap so that no window is lost.
PIECE_WORDS = 4096
ADDED = ("n_words", "hit_spans", "item_ids")
SIEVE_BITS = 22


@dataclass
class Block:
    """Windows of one block, sorted by hash: windows of ``pieces[piece[i]]`` from byte ``start[i]`` to ``end[i]``."""

    widths: list[int]
    hashes: dict[int, np.ndarray]
    piece: dict[int, np.ndarray]
    start: dict[int, np.ndarray]
    end: dict[int, np.ndarray]
    sieve: dict[int, np.ndarray]
    pieces: list[bytes]
    items: list[str | None]


def normalised_pieces(benchmark: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """``item_id, words``: lower-cased words joined by spaces, long items in overlapping pieces."""
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("words", T.BinaryType())])

    def work(batch: pa.RecordBatch) -> dict:
        words, ids, out = split_words(batch.column(1), ALPHANUMERIC, lower=True), batch.column(0).to_pylist(), ([], [])
        for d in range(len(words)):
            a, b = int(words.first[d]), int(words.first[d + 1])
            for at in range(a, max(a + 1, b - width + 1), PIECE_WORDS):
                if b > a:
                    out[0].append(ids[d])
                    out[1].append(words.joined(at, min(b, at + PIECE_WORDS + width - 1)))
        return {"item_id": out[0], "words": out[1]}

    return arrow_map(benchmark.select(F.col(item).cast("string").alias("item_id"), F.col(text).alias("text")), work, schema)


def build_block(rows: list, width: int) -> Block:
    pieces, items = [bytes(r["words"]) for r in rows], [r["item_id"] for r in rows]
    words = split_words(pa.array([p.decode("utf-8", "replace") for p in pieces], pa.string()), ALPHANUMERIC)
    counts = words.counts()
    doc = np.repeat(np.arange(len(words)), counts)
    found: dict[int, tuple] = {}
    for w in sorted({int(min(c, width)) for c in counts if c}):
        own = np.flatnonzero(words.full(w) & (np.minimum(counts, width)[doc] == w))
        h = words.windows(w)[own]
        order = np.argsort(h, kind="stable")
        own, h = own[order], h[order]
        base = words.offsets[doc[own]]
        sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
        sieve[h >> np.uint64(64 - SIEVE_BITS)] = True
        found[w] = (h, doc[own], words.starts[own] - base, words.ends[own + w - 1] - base, sieve)
    return Block(list(found), *[{w: f[i] for w, f in found.items()} for i in range(5)], pieces, items)


def blocks(benchmark: DataFrame, item: str, text: str, width: int, block_bytes: int):
    """One Block after the other; the driver holds one at a time."""
    pieces = materialise(normalised_pieces(benchmark, item, text, width), "benchmark_pieces")
    total = pieces.agg(F.sum(F.length("words"))).head()[0] or 0
    # A piece is at most PIECE_WORDS + width words; hashing spreads pieces, so half the bound leaves room for chance.
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for b in range(n):
        rows = pieces.filter(F.pmod(F.xxhash64("words"), F.lit(n)) == b).orderBy("item_id", "words").collect()
        if rows:
            yield build_block(rows, width)


def _hits(words, block: Block) -> tuple[np.ndarray, list[set[int]]]:
    """Hit words of a batch, and per document the pieces with a window in it; every hit is compared in full."""
    hit, by_doc = np.zeros(len(words.hashes), dtype=bool), [set() for _ in range(len(words))]
    for w in block.widths:
        h = words.windows(w)
        maybe = np.flatnonzero(block.sieve[w][h >> np.uint64(64 - SIEVE_BITS)] & words.full(w))
        if not len(maybe):
            continue
        low = np.searchsorted(block.hashes[w], h[maybe], side="left")
        high = np.searchsorted(block.hashes[w], h[maybe], side="right")
        kept, docs = [], np.searchsorted(words.first, maybe, side="right") - 1
        for at, d, a, b in zip(maybe.tolist(), docs.tolist(), low.tolist(), high.tolist(), strict=True):
            if a == b:
                continue
            here, same = words.joined(at, at + w), False
            for i in range(a, b):
                p = int(block.piece[w][i])
                if block.pieces[p][block.start[w][i] : block.end[w][i]] == here:
                    by_doc[d].add(p)
                    same = True
            if same:
                kept.append(at)
        hit |= covered(len(hit), np.array(kept, dtype=np.int64), w)
    return hit, by_doc


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WIDTH, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` plus ``n_words``, ``hit_spans`` (word runs as from, to, from, to, ...) and sorted ``item_ids``."""
    out = without(docs, *ADDED)
    schema = T.StructType([
        *out.schema.fields, T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.LongType())), T.StructField("item_ids", T.ArrayType(T.StringType())),
    ])
    sc, found = docs.sparkSession.sparkContext, False
    for block in blocks(benchmark, item, item_text, width, block_bytes):
        if found:
            out = materialise(out, "scanned")
        out = _scan_block(out, schema, text, sc.broadcast(block), found)
        found = True
    return out if found else _scan_block(out, schema, text, sc.broadcast(build_block([], width)), False)


def _scan_block(df: DataFrame, schema: T.StructType, text: str, block, again: bool) -> DataFrame:
    names = [f.name for f in schema.fields]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                words = split_words(batch.column(text), ALPHANUMERIC, lower=True)
                hit, pieces = _hits(words, block.value)
                items = [{block.value.items[p] for p in found} - {None} for found in pieces]
                if again:
                    for d, (spans, old) in enumerate(zip(batch.column("hit_spans").to_pylist(), batch.column("item_ids").to_pylist(), strict=True)):
                        items[d] |= set(old)
                        for a, b in zip(spans[::2], spans[1::2], strict=True):
                            hit[words.first[d] + a : words.first[d] + b] = True
                new = {"n_words": pa.array(words.counts(), pa.int64()), "hit_spans": _spans(hit, words.first), "item_ids": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n) if n not in new else None) for n in names], names=names)

    return df.mapInArrow(run, schema)


def _spans(hit: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of hit words, counted within their documents."""
    n, edges = len(hit), first[(first > 0) & (first < len(hit))]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if n:
        before[1:], after[:-1] = hit[:-1], hit[1:]
        before[edges], after[edges - 1] = False, False
    a, b = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    doc = np.searchsorted(first, a, side="right") - 1
    flat = np.stack([a - first[doc], b - first[doc]], axis=1).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(2 * np.searchsorted(a, first), pa.int32()), pa.array(flat, pa.int64()))


def hit_words(spans: str = "hit_spans"):
    """Number of words in the spans."""
    signed = F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, or (``remove='spans'``) without the hit words.

    A cut goes from the first byte of the first hit word to the last byte of the last one of a run.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    # Columns of the input that scanning would replace step aside meanwhile.
    aside = {c: f"{c} of {uuid.uuid4().hex}" if c.lower() in ADDED else c for c in docs.columns}
    text = aside.get(text, text)
    found = scan(docs.withColumnsRenamed(aside), benchmark, text=text, **options)
    back = [F.col(f"`{new}`").alias(old) for old, new in aside.items()]
    if remove == "documents":
        return found.filter(F.size("hit_spans") == 0).select(*back)
    kept = list(aside.values())
    schema = T.StructType([f for f in found.schema.fields if f.name in kept])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                words, texts = split_words(batch.column(text), ALPHANUMERIC, lower=True), batch.column(text).to_pylist()
                for d, spans in enumerate(batch.column("hit_spans").to_pylist()):
                    if spans:
                        raw, base = texts[d].encode(), int(words.offsets[d])
                        cuts = [(int(words.starts[words.first[d] + a]) - base, int(words.ends[words.first[d] + b - 1]) - base) for a, b in zip(spans[::2], spans[1::2], strict=True)]
                        texts[d] = b"".join(raw[x:y] for x, y in zip([0, *[c[1] for c in cuts]], [*[c[0] for c in cuts], len(raw)], strict=True)).decode()
                yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(text).type) if n == text else batch.column(n) for n in kept], names=kept)

    return found.mapInArrow(run, schema).select(*back)
