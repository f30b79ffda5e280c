"""Quality by distribution divergence: character-class and common-word histograms against references per language.

A reference is taken over all documents of a language: the mean of the documents' character-class histograms, and the
shares of its common words, which are those with at least ``common_share`` of all words of the language. The distance is
the square root of the Jensen-Shannon divergence to base 2, from 0 to 1. A document is judged by a histogram only if it
is long enough for it.

A language has at most 1 / common_share common words. It has a class histogram of its own from ``min_language_chars``
characters and a word histogram from ``min_language_words`` words, however large the rest of the corpus is; by one that
it does not have, its documents are not judged. References are broadcast in blocks of at most ``block_languages``
languages, one pass over the documents for each block, so their number has no limit; all but noisy language columns
need one pass. A word that is common in a language is common in at least one task's part of it, so only there is its text
sent along; everywhere else its hash and count are enough.

Defined cases: a null text has no words; a null language is a language of its own, named ''; a document too short for a
histogram is not judged by it; an empty table gives no rows. Repeated rows are judged each. Columns of the input
other than the named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .words import NOT_SPACE, Words, covered, slices, split_words, text_buffer

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: Sums over documents are of whole millionths, so that they do not depend on the order of addition.
UNIT = 1_000_000
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "quote", "symbol", "control", "latin", "wide", "other")


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    repeat_percent: int = 20
    common_share: float = 0.002
    block_languages: int = 2000
    min_language_chars: int = 2000
    min_language_words: int = 1000
    min_class_chars: int = 200
    min_common_words: int = 100
    max_class_distance: float = 0.35
    max_word_distance: float = 0.45


def _class_table() -> np.ndarray:
    """Class of every byte; a character counts once, at its first byte, so the bytes that follow have no class."""
    out = np.full(256, len(CLASSES), dtype=np.int64)
    out[:128] = CLASSES.index("control")
    for name, members in (
        ("symbol", rb"""!#$%&*+/<=>@[\]^_`{|}~()"""), ("stop", b".,;:?-"), ("quote", b"\"'"), ("space", b" \t"), ("line", b"\n\r"),
        ("digit", b"0123456789"), ("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))),
    ):
        out[np.frombuffer(members, dtype=np.uint8)] = CLASSES.index(name)
    out[0xC2:0xCA] = CLASSES.index("latin")
    out[0xCA:0xF0] = CLASSES.index("wide")
    out[0xF0:] = CLASSES.index("other")
    return out


CLASS_OF = _class_table()


def class_histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each class, a row per document."""
    n, width = len(offsets) - 1, len(CLASSES) + 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(doc * width + CLASS_OF[data], minlength=n * width).reshape(n, width)[:, : len(CLASSES)]


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to a distribution; rows without counts have distance 0."""
    total = counts.sum(axis=1, keepdims=True)
    p, q = counts / np.maximum(total, 1), np.broadcast_to(reference, counts.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(parts.sum(axis=1) / 2, 0, 1)), 0.0)


#: One row per language and counted thing: a word (by hash), a character class, all words, all characters.
PARTIAL = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("word", T.StringType()),
])
#: Distinct words of one task that are held before they are sent on.
HELD = 1 << 20


def _named(docs: DataFrame, lang: str, text: str, *more: str) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word counts of several parts as one; a word keeps its text if any part has it."""
    hashes, counts, texts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((texts == "", hashes))
    hashes, counts, texts = hashes[order], counts[order], texts[order]
    begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[begins], np.add.reduceat(counts, begins), texts[begins]


def corpus_counts(docs: DataFrame, rules: Rules) -> DataFrame:
    """What the references are made of, over all documents: few rows, for words without a text cannot be common."""

    def run(batches):
        held: dict[str, list] = {}

        def rows(lang, kind, keys, counts, texts=None):
            n = len(keys)
            return pa.RecordBatch.from_arrays([
                pa.array([lang] * n, pa.string()), pa.array([kind] * n, pa.string()), pa.array(np.asarray(keys).astype(np.int64)), pa.array(np.asarray(counts).astype(np.int64)),
                pa.array([t or None for t in texts] if texts is not None else [""] * n, pa.string()),
            ], names=PARTIAL.names)

        for whole in batches:
            for batch in slices(whole, "text"):
                words = split_words(batch.column("text"), NOT_SPACE, lower=True)
                langs = np.array(batch.column("lang").to_pylist(), dtype=object)
                classes = class_histograms(*text_buffer(batch.column("text")))
                chars = classes.sum(axis=1)
                of_word = np.repeat(np.arange(len(words)), words.counts())
                for lang in set(langs.tolist()):
                    own = langs == lang
                    at, filled = np.flatnonzero(own[of_word]), own & (chars > 0)
                    yield rows(lang, "class", range(len(CLASSES)), (classes[filled] * UNIT // chars[filled, None]).sum(axis=0))
                    yield rows(lang, "total", [0], [len(at)])
                    yield rows(lang, "chars", [0], [chars[own].sum()])
                    if len(at):
                        hashes, first, counts = np.unique(words.hashes[at], return_index=True, return_counts=True)
                        texts = np.full(len(hashes), "", dtype=object)
                        for i in np.flatnonzero(counts >= rules.common_share * len(at)):
                            w = at[first[i]]
                            texts[i] = words.data[words.starts[w] : words.ends[w]].tobytes().decode()
                        held.setdefault(lang, []).append((hashes.view(np.int64), counts, texts))
                if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                    held = {lang: [_merge(parts)] for lang, parts in held.items()}
                    if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                        for lang, [(hashes, counts, texts)] in held.items():
                            yield rows(lang, "word", hashes, counts, texts)
                        held = {}
        for lang, parts in held.items():
            hashes, counts, texts = _merge(parts)
            yield rows(lang, "word", hashes, counts, texts)

    summed = docs.mapInArrow(run, PARTIAL).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"), F.max("word").alias("word"))
    return summed.filter("word IS NOT NULL")


@dataclass(frozen=True)
class Reference:
    """Mean class histogram, and hashes (sorted) and shares of the common words with the share of all others last.

    ``by_class`` and ``by_word``: whether there is enough text to judge by each.
    """

    classes: np.ndarray
    words: np.ndarray
    shares: np.ndarray
    by_class: bool = True
    by_word: bool = True


def reference_counts(docs: DataFrame, rules: Rules) -> DataFrame:
    """The counts that references are made of, for languages with enough text for a histogram, stored."""
    counts = materialise(corpus_counts(docs, rules), "corpus_counts")
    sizes = counts.filter("kind IN ('total', 'chars')").groupBy("lang")
    totals = sizes.agg(F.max(F.when(F.col("kind") == "total", F.col("n"))).alias("total"), F.max(F.when(F.col("kind") == "chars", F.col("n"))).alias("chars"))
    large = totals.filter((F.col("chars") >= rules.min_language_chars) | (F.col("total") >= rules.min_language_words))
    wanted = counts.join(large, "lang").filter((F.col("kind") == "class") | ((F.col("kind") == "word") & (F.col("n") >= rules.common_share * F.col("total"))))
    return materialise(wanted.select("lang", "kind", "key", "n", "total", "chars"), "reference_counts")


def build_references(rows: list, rules: Rules) -> dict[str, Reference]:
    """By language, from rows of ``reference_counts``."""
    found: dict[str, dict] = {}
    for r in rows:
        one = found.setdefault(r["lang"], {"class": np.zeros(len(CLASSES)), "words": {}, "total": max(1, r["total"]), "chars": r["chars"]})
        if r["kind"] == "class":
            one["class"][r["key"]] = r["n"]
        else:
            one["words"][r["key"] % (1 << 64)] = r["n"]
    out = {}
    for lang, one in found.items():
        hashes = np.array(sorted(one["words"]), dtype=np.uint64)
        shares = np.array([one["words"][int(h)] for h in hashes], dtype=float) / one["total"]
        by_class, by_word = one["chars"] >= rules.min_language_chars, one["total"] >= rules.min_language_words
        out[lang] = Reference(one["class"] / max(1.0, one["class"].sum()), hashes, np.append(shares, max(0.0, 1 - shares.sum())), by_class, by_word)
    return out


def word_histograms(words: Words, docs: np.ndarray, reference: Reference) -> np.ndarray:
    """Counts of the reference's words and of all others in some documents (a mask)."""
    of_word = np.repeat(np.arange(len(words)), words.counts())
    at, n, width = np.flatnonzero(docs[of_word]), int(docs.sum()), len(reference.words) + 1
    place = np.minimum(np.searchsorted(reference.words, words.hashes[at]), max(0, width - 2))
    place = np.where(reference.words[place] == words.hashes[at], place, width - 1) if width > 1 else np.zeros(len(at), dtype=np.int64)
    row = np.cumsum(docs)[of_word[at]] - 1
    return np.bincount(row * width + place, minlength=n * width).reshape(n, width)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def repeated_words(words: Words) -> np.ndarray:
    """Words in five-word windows that a document has twice or more."""
    windows, out = words.windows(WINDOW), np.zeros(len(words), dtype=np.int64)
    for d, (a, n) in enumerate(zip(words.first[:-1].tolist(), words.counts().tolist(), strict=True)):
        if n > WINDOW:
            own = windows[a : a + n - WINDOW + 1]
            ordered = np.sort(own)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                starts = np.flatnonzero(np.isin(own, twice))
                out[d] = covered(n, starts, WINDOW).sum()
    return out


JUDGED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()),
])
SYMBOL_TABLE = np.isin(np.arange(256), np.frombuffer(SYMBOLS, dtype=np.uint8))


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(sums[offsets])


def judge(docs: DataFrame, rules: Rules = Rules(), doc: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Counts, both distances (null where the text or all of its language is too short for them) and the verdict for every row."""
    source = _named(docs, lang, text, F.col(doc).cast("bigint").alias("doc_id"))
    counts = reference_counts(_named(docs, lang, text), rules)
    n = max(1, -(-counts.select("lang").distinct().count() // rules.block_languages))
    block = F.pmod(F.xxhash64("lang"), F.lit(n))
    parts = [_judge_block(source.filter(block == b) if n > 1 else source, build_references(counts.filter(block == b).collect(), rules), rules) for b in range(n)]
    return reduce(DataFrame.unionByName, parts)


def _judge_block(source: DataFrame, references: dict[str, Reference], rules: Rules) -> DataFrame:
    known = source.sparkSession.sparkContext.broadcast(references)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                words, langs = split_words(batch.column("text")), np.array(batch.column("lang").to_pylist(), dtype=object)
                data, offsets, n_words = words.data, words.offsets, words.counts()
                lowered = split_words(batch.column("text"), NOT_SPACE, lower=True)
                classes = class_histograms(data, offsets)
                by_class, by_word = np.zeros(len(words)), np.zeros(len(words))
                class_judged, word_judged = classes.sum(axis=1) >= rules.min_class_chars, n_words >= rules.min_common_words
                for one in set(langs.tolist()):
                    own = langs == one
                    reference = known.value.get(one)
                    class_judged[own] &= reference is not None and reference.by_class
                    word_judged[own] &= reference is not None and reference.by_word
                    if reference is None:
                        continue
                    by_class[own] = distance(classes[own], reference.classes)
                    by_word[own] = distance(word_histograms(lowered, own, reference), reference.shares)
                repeated = repeated_words(words)
                failed = (n_words < rules.min_words) | (100 * repeated > rules.repeat_percent * n_words)
                far = (class_judged & (by_class > rules.max_class_distance)) | (word_judged & (by_word > rules.max_word_distance))
                duplicates = [duplicate_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(_per_doc(NOT_SPACE[data] & (data & 0xC0 != 0x80), offsets)),
                    pa.array(_per_doc(SYMBOL_TABLE[data], offsets)), pa.array(duplicates, pa.int64()), pa.array(repeated),
                    pa.array(failed), pa.array(~failed & ~far), pa.array(by_class, mask=~class_judged), pa.array(by_word, mask=~word_judged),
                ], names=JUDGED.names)

    return source.mapInArrow(run, JUDGED)
