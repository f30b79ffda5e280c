"""Repeated substrings of words by prefix-partitioned suffix trees.

A repeat is a run of ``window`` words that starts in two documents. Suffixes are split into groups by prefixes of variable
length: the prefix of a window reaches from its first word to the end of its anchor, the leftmost 16-word gram of the
smallest hash in it. Equal windows have equal anchors at equal places, so no repeat is split between groups; windows that
lie side by side share an anchor, so a stretch of text travels once for about twenty of its suffixes. A gram that occurs
in one document only can head no repeat; its suffixes are left out before any text is sent.

What is left of a group is its suffix subtree. The suffixes that begin with the gram are sorted word by word; the common
length of neighbours gives the internal nodes of every depth. The words before the gram, read backwards, give a second
tree in the same way. A window with ``o`` words before its anchor is an internal node of depth ``window - o`` of the first
together with one of depth ``o`` of the second: a node that is deep enough, and the least document below it keeps its copy.
Windows of such nodes that overlap make up the maximal repeats.

Groups share cells of bounded bytes, one task call each. Of a gram with more than ``largest`` suffixes, fragments that are
alike word for word are made one first, partially before anything is shuffled; if there are still more, its prefixes are
lengthened to the whole window, where a node needs no tree but only its least document, again summed up partially. So a
passage of any frequency is split over all tasks, and no group of pairs is ever made.

Words are compared by 64-bit hashes; fragments and windows of frequent grams by 128 bits.

Defined cases: null and empty texts have no words; a text shorter than a window loses nothing; repeats inside one document
(or between rows of equal ids) are kept; rows that repeat an id and text get equal results; a row without an id neither
loses words nor makes others lose them; ties do not arise, since the least id keeps its words; an empty table gives no rows.
Columns of the input with the names of added columns are replaced; others, whatever their names, are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import broadcast_if_bytes, without
from .words import NOT_SPACE, WINDOW_BASE, Words, covered, mix, slices, split_words

KEY = ["doc_id", "text_key"]


@dataclass(frozen=True)
class Settings:
    """``window``: words of a repeat; ``gram``: words of an anchor; ``largest``: suffixes of one
    group, which take about 20 MB; ``cell_bytes``: of the groups that share a cell, on average."""

    window: int = 50
    gram: int = 16
    largest: int = 1 << 15
    cell_bytes: int = 8 << 20

    def __post_init__(self):
        if not 0 < self.gram <= self.window < self.gram + 62:
            raise ValueError("A window holds its anchor and has at most 62 places for it.")


@dataclass
class Runs:
    """Windows that share an anchor: they start at the words ``low`` to ``high``; the anchor starts at ``at``."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    gram: np.ndarray
    doc: np.ndarray


def anchors(words: Words, settings: Settings) -> Runs:
    """The anchors of all whole windows, in text order."""
    grams, width = words.windows(settings.gram), settings.window - settings.gram + 1
    starts = np.flatnonzero(words.full(settings.window))
    least, offset, reach = grams, np.zeros(len(grams), dtype=np.int64), 1
    while reach < width and len(starts):
        step = min(reach, width - reach)
        later = least[step:] < least[:-step]
        least, offset = np.where(later, least[step:], least[:-step]), np.where(later, offset[step:] + step, offset[:-step])
        reach += step
    at = starts + offset[starts]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    at, low, high = at[first], starts[first], starts[np.append(first[1:], len(starts)) - 1] if len(first) else starts
    return Runs(at, low, high, grams[at], np.searchsorted(words.first, at, side="right") - 1)


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc_id, text_key, text``: the key tells rows of one id with different texts apart."""
    return docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").alias("text"))


#: Numbers of documents that are broadcast to find the rows to be shuffled, at 24 bytes each.
BROADCAST_KEYS = 3_000_000


def _join_few(docs: DataFrame, few: DataFrame, all_rows: bool) -> DataFrame:
    """``docs`` joined with the stored ``few`` on KEY; with ``all_rows`` the other rows stay, with nulls.

    Texts move only if they have to: a number of every document in ``few`` is broadcast, and rows without one stay where
    they are. With more documents than that, all rows are shuffled.
    """
    own = docs.join(few, KEY, "left" if all_rows else "inner")
    if few.count() > BROADCAST_KEYS:
        return own
    number = F.xxhash64(*KEY)
    numbers, numbered = F.broadcast(few.select(number.alias("number")).distinct()), docs.withColumn("number", number)
    own = numbered.join(numbers, "number", "left_semi").drop("number").join(few, KEY, "left" if all_rows else "inner")
    if not all_rows:
        return own
    rest = numbered.join(numbers, "number", "left_anti").drop("number")
    return own.unionByName(rest, allowMissingColumns=True)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


ANCHORS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text_key", T.LongType()), ("at", T.ArrayType(T.IntegerType())), ("gram", T.ArrayType(T.LongType())))])


def find_anchors(keyed: DataFrame, settings: Settings) -> DataFrame:
    """Per document with a whole window the places and grams of its anchors."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                words = split_words(batch.column("text"), NOT_SPACE)
                found = anchors(words, settings)
                ends = np.searchsorted(found.doc, np.arange(len(words) + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("text_key"), _lists(found.at - words.first[found.doc], ends, pa.int32()), _lists(found.gram.view(np.int64), ends, pa.int64()),
                ], names=ANCHORS.names).filter(pa.array(np.diff(ends) > 0))

    return keyed.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, ANCHORS)


FRAGMENT = T.StructType([T.StructField(n, t) for n, t in (
    ("gram", T.LongType()), ("doc_id", T.LongType()), ("text_key", T.LongType()), ("at", T.IntegerType()), ("most", T.IntegerType()), ("least", T.IntegerType()), ("words", T.BinaryType())
)])


def _chosen(batch: pa.RecordBatch, settings: Settings) -> tuple[Words, Runs]:
    """Words of a batch and those of its anchors that the column ``places`` names."""
    words = split_words(batch.column("text"), NOT_SPACE)
    found, places = anchors(words, settings), batch.column("places")
    wanted = places.flatten().to_numpy() + np.repeat(words.first[:-1], places.value_lengths().to_numpy())
    kept = np.isin(found.at, wanted)
    return words, Runs(*[getattr(found, n)[kept] for n in ("at", "low", "high", "gram", "doc")])


def fragments(suspects: DataFrame, settings: Settings) -> DataFrame:
    """A row per anchor in ``places``: the hashes of the words of all its windows, of which ``most`` words to ``least``
    words stand before the anchor."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                words, found = _chosen(batch, settings)
                size = found.high - found.low + settings.window
                ends = np.concatenate([[0], np.cumsum(size)])
                flat = words.hashes[np.arange(ends[-1]) - np.repeat(ends[:-1] - found.low, size)]
                texts = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer((8 * ends).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                own = pa.array(found.doc)
                yield pa.RecordBatch.from_arrays([
                    pa.array(found.gram.view(np.int64)), batch.column("doc_id").take(own), batch.column("text_key").take(own), pa.array(found.at - words.first[found.doc], pa.int32()),
                    pa.array(found.at - found.low, pa.int32()), pa.array(found.at - found.high, pa.int32()), texts,
                ], names=FRAGMENT.names)

    return suspects.mapInArrow(run, FRAGMENT)


def suffix_tree(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows, and with how many leading words each of them agrees with the one before."""
    width = strings.shape[1]
    order = np.argsort(np.ascontiguousarray(strings).view(f"V{8 * width}").ravel(), kind="stable")
    differ = strings[order[1:]] != strings[order[:-1]]
    return order, np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), width)])


def nodes(tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """For each row the number of its node of this depth."""
    order, common = tree
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def deep_copies(flat: np.ndarray, ends: np.ndarray, most: np.ndarray, least: np.ndarray, docs: np.ndarray, settings: Settings) -> np.ndarray:
    """For each fragment a bit per number of words before the anchor, set if that window starts in a smaller document too.

    Row i has the words ``flat[ends[i]:ends[i + 1]]``, of which the anchor's are from ``most[i]`` on.
    """
    n, anchor = len(most), ends[:-1] + most
    ahead = anchor[:, None] + np.arange(settings.window)
    right = np.where(ahead < ends[1:, None], flat[np.minimum(ahead, len(flat) - 1)], np.uint64(0))
    down = suffix_tree(right)
    places = settings.window - settings.gram + 1
    if places > 1:
        behind = anchor[:, None] - np.arange(1, places)
        back = suffix_tree(np.where(behind >= ends[:-1, None], flat[np.maximum(behind, 0)], np.uint64(0)))
    gone = np.zeros(n, dtype=np.int64)
    for o in range(places):
        own = np.flatnonzero((most >= o) & (least <= o))
        if len(own) < 2:
            continue
        node = nodes(down, settings.window - o)[own] * (n + 1) + (nodes(back, o)[own] if o else 0)
        order = np.lexsort((docs[own], node))
        first = np.flatnonzero(np.diff(node[order], prepend=-1))
        smallest = np.repeat(docs[own][order][first], np.diff(np.append(first, len(order))))
        gone[own[order]] |= (docs[own][order] > smallest).astype(np.int64) << o
    return gone


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes in a binary column, and where each row's begin and end."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view("<u8"), (ends - ends[0]) // 8


MARKS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text_key", T.LongType()), ("at", T.IntegerType()), ("before", T.LongType()))])


def copies_in_trees(found: DataFrame, cells: int, settings: Settings) -> DataFrame:
    """``doc_id, text_key, at, before``: the windows that start ``o`` words before the word ``at`` for each bit o."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        column = {c: cell.column(c).chunk(0) for c in ("doc_id", "text_key", "at", "most", "least")}
        flat, ends = _word_hashes(cell.column("words").chunk(0))
        most, least, docs = (column[c].to_numpy().astype(np.int64) for c in ("most", "least", "doc_id"))
        gone = deep_copies(flat, ends, most, least, docs, settings)
        hit = pa.array(np.flatnonzero(gone))
        return pa.table([column["doc_id"].take(hit), column["text_key"].take(hit), column["at"].take(hit), pa.array(gone[gone != 0])], names=MARKS.names)

    return found.withColumn("cell", F.pmod("gram", F.lit(cells))).groupBy("cell").applyInArrow(run, MARKS)


def _fingerprints(flat: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the ``width`` words from each of ``starts`` on."""
    out = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        own, total = mix(flat ^ np.uint64(seed)), np.zeros(len(starts), dtype=np.uint64)
        for j in range(width):
            total = total * np.uint64(WINDOW_BASE) + own[starts + j]
        out.append(mix(total))
    return out[0], out[1]


WHOLE = T.StructType([T.StructField(n, t) for n, t in (
    ("one", T.LongType()), ("two", T.LongType()), ("doc_id", T.LongType()), ("text_key", T.LongType()), ("at", T.IntegerType()), ("o", T.IntegerType())
)])


def whole_windows(found: DataFrame, settings: Settings) -> DataFrame:
    """A row per window of the fragments: 128 bits of its words, and how many of them stand before the anchor."""

    def run(batches):
        for batch in batches:
            flat, ends = _word_hashes(batch.column("words"))
            most, least = (batch.column(c).to_numpy().astype(np.int64) for c in ("most", "least"))
            size = most - least + 1
            own, o = np.repeat(np.arange(len(size)), size), np.repeat(most + np.cumsum(size) - size, size) - np.arange(size.sum())
            one, two = _fingerprints(flat, ends[:-1][own] + most[own] - o, settings.window)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *[batch.column(c).take(pa.array(own)) for c in (*KEY, "at")], pa.array(o, pa.int32())], names=WHOLE.names)

    return found.select(*KEY, "at", "most", "least", "words").mapInArrow(run, WHOLE)


def copies_of_windows(found: DataFrame, settings: Settings) -> DataFrame:
    """As ``copies_in_trees``, for fragments whose prefix is lengthened to the whole window."""
    windows = materialise(whole_windows(found, settings), "whole_windows")
    smallest = windows.groupBy("one", "two").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("_largest")).filter("smallest < _largest").drop("_largest")
    smallest = materialise(smallest, "frequent_windows")
    gone = windows.join(broadcast_if_bytes(smallest, F.lit(24)), ["one", "two"]).filter("doc_id > smallest")
    return gone.groupBy(*KEY, "at").agg(F.bit_or(F.expr("shiftleft(1L, o)")).alias("before"))


def copies_of_frequent(found: DataFrame, settings: Settings) -> DataFrame:
    """As ``copies_in_trees``, for grams of more than ``largest`` suffixes.

    Fragments that are alike, word for word, are one first: the one of the least document. Only where a gram has more
    than ``largest`` different fragments, their prefixes are lengthened.
    """
    place = F.struct(*KEY, "at")
    named = materialise(found.withColumn("one", F.xxhash64("words", "most")).withColumn("two", F.xxhash64(F.lit(1), "words", "most")), "frequent_fragments")
    alike = named.groupBy("gram", "one", "two").agg(F.min(place).alias("first"), F.min("most").alias("most"), F.min("least").alias("least"), F.any_value("words").alias("words"))
    alike = materialise(alike.select("gram", "one", "two", "first.*", "most", "least", "words"), "different_fragments")
    grams = materialise(alike.groupBy("gram").agg((F.count(F.lit(1)) > settings.largest).alias("many"), F.count(F.lit(1)).alias("n")), "frequent_grams")
    parts = []
    for r in grams.groupBy("many").agg(F.sum("n").alias("n")).collect():
        own = alike.join(broadcast_if_bytes(grams.filter(F.col("many") == r["many"]).select("gram"), F.lit(8)), "gram", "left_semi")
        parts.append(copies_of_windows(own, settings) if r["many"] else copies_in_trees(own.select(*FRAGMENT.names), _cells(own, r["n"], settings), settings))
    marks = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    # Later fragments lose all their windows, those of the least document what its own fragment loses.
    known = materialise(alike.select("one", "two", *KEY, "at").join(marks, [*KEY, "at"], "left").select("one", "two", F.col("doc_id").alias("least_doc"), F.coalesce("before", F.lit(0).cast("bigint")).alias("own")), "fragment_marks")
    every = F.expr("shiftleft(shiftleft(1L, most - least + 1) - 1L, least)")
    joined = named.join(broadcast_if_bytes(known, F.lit(32)), ["one", "two"])
    return joined.select(*KEY, "at", F.when(F.col("doc_id") > F.col("least_doc"), every).otherwise(F.col("own")).alias("before")).filter("before != 0")


def _cells(df: DataFrame, n: int, settings: Settings) -> int:
    """How many cells n fragments are spread over."""
    return max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * 12 * settings.window // settings.cell_bytes))


def marked_windows(docs: DataFrame, settings: Settings = Settings(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, marks`` of the documents that lose words; ``marks`` has structs (at, before), stored."""
    keyed = _keyed(docs, doc, text)
    placed = materialise(find_anchors(keyed, settings), "anchors")
    counted = placed.select("doc_id", F.explode("gram").alias("gram")).groupBy("gram").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"), F.count(F.lit(1)).alias("n"))
    grams = materialise(counted.filter("_low < _high").select("gram", (F.col("n") > settings.largest).alias("frequent"), "n"), "repeated_grams")
    sizes = {r["frequent"]: r["n"] for r in grams.groupBy("frequent").agg(F.sum("n").alias("n")).collect()}
    single = placed.select(*KEY, F.explode(F.arrays_zip("at", "gram")).alias("x")).select(*KEY, "x.at", "x.gram")
    shared = single.join(broadcast_if_bytes(grams.drop("n"), F.lit(16)), "gram")
    suspects = materialise(shared.groupBy(*KEY, "frequent").agg(F.collect_set("at").alias("places")), "suspects")
    parts = []
    for frequent, n in sizes.items():
        texts = _join_few(keyed, suspects.filter(F.col("frequent") == frequent).drop("frequent"), False).select(*KEY, "text", "places")
        found = fragments(texts, settings)
        parts.append(copies_of_frequent(found, settings) if frequent else copies_in_trees(found, _cells(docs, n, settings), settings))
    empty = docs.sparkSession.createDataFrame([], MARKS)
    gone = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else empty
    return materialise(gone.groupBy(*KEY).agg(F.collect_set(F.struct("at", "before")).alias("marks")), "marked_windows")


JUDGED = "struct<n_words: bigint, n_removed: bigint, spans: array<bigint>, kept: string>"


def _join_kept(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of every document with one space between."""
    own = np.flatnonzero(kept)
    doc = np.searchsorted(words.first, own, side="right") - 1
    last = np.diff(doc, append=-1) != 0
    data, change = np.append(words.data, np.uint8(0)), np.zeros(len(words.data) + 2, dtype=np.int8)
    data[words.ends[own[~last]]] = 0x20
    change[words.starts[own]] += 1
    change[words.ends[own] + ~last] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8) > 0
    ends = np.concatenate([[0], np.cumsum(inside)])[words.offsets]
    return pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inside])]).cast(pa.string())


def _spans(gone: np.ndarray, words: Words) -> pa.Array:
    """Runs of removed words as from, to, from, to, ..., counted within their documents."""
    own = np.flatnonzero(gone)
    doc = np.searchsorted(words.first, own, side="right") - 1
    begins = (np.diff(own, prepend=-2) > 1) | (np.diff(doc, prepend=-1) != 0)
    a, b = own[begins], own[np.append(begins[1:], True)] + 1 if len(own) else own
    of = doc[begins]
    return _lists(np.stack([a - words.first[of], b - words.first[of]], axis=1).reshape(-1), 2 * np.searchsorted(of, np.arange(len(words) + 1)), pa.int64())


def _judged(docs: DataFrame, settings: Settings, doc: str, text: str) -> DataFrame:
    """The struct ``row`` with all columns of ``docs``, so that none can clash with others, and the struct ``judged``."""
    marks = marked_windows(docs, settings, doc, text)
    window = settings.window

    @F.arrow_udf(JUDGED)
    def look(texts: pa.Array, marked: pa.Array) -> pa.Array:
        parts = []
        for batch in slices(pa.RecordBatch.from_arrays([texts, marked], names=["text", "marks"]), "text"):
            words, own = split_words(batch.column("text"), NOT_SPACE), batch.column("marks")
            sizes = own.value_lengths().fill_null(0).to_numpy()
            at, before = (own.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            at, gone = at + np.repeat(words.first[:-1], sizes), np.zeros(len(words.hashes), dtype=bool)
            starts = np.concatenate([at[before >> o & 1 == 1] - o for o in range(window)]) if len(at) else at
            gone |= covered(len(gone), starts, window)
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            parts.append(pa.StructArray.from_arrays([pa.array(words.counts(), pa.int64()), pa.array(lost, pa.int64()), _spans(gone, words), _join_kept(words, ~gone)], names=["n_words", "n_removed", "spans", "kept"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.string())]))

    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    held = held.select("row", F.col(f"row.`{doc}`").cast("bigint").alias("doc_id"), F.xxhash64(F.col(f"row.`{text}`")).alias("text_key"))
    joined = _join_few(held, marks, True)
    return joined.select("row", look(F.col(f"row.`{text}`"), F.col("marks")).alias("judged"))


def judge(docs: DataFrame, settings: Settings = Settings(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` plus the struct ``judged``: ``n_words, n_removed, spans`` (the maximal repeats that go, as word numbers
    from, to, from, to, ...) and ``kept``, the other words with one space between."""
    kept = without(docs, "judged").columns
    return _judged(docs, settings, doc, text).select(*[F.col(f"row.`{c}`") for c in kept], "judged")


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the words of later copies; a text that loses nothing stays as it is, white space and all."""
    left = F.when(F.col("judged.n_removed") > 0, F.col("judged.kept")).otherwise(F.col(f"row.`{text}`"))
    return _judged(docs, settings, doc, text).select(*[left.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
