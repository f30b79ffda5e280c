"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Fitting is crossed over ``folds`` folds of the learnable rows, dealt within each label by a hash of the id: the features of
a fold come from a lexicon of words and word beginnings that toxic documents of the other folds prefer, the trees
(pyspark.ml) that score a fold have not seen it, and the calibration (pyspark.ml isotonic regression) is fitted on all
these scores together. What is used afterwards is the lexicon of all folds and the trees of all their rows. Features are
densities of lexicon terms, how near they stand to second-person words, shares of capitals, punctuation marks and
spelled-over words (letters replaced by digits or signs). Labels, language, source and ids are never features.

Word beginnings are exact: the first 4 to 8 bytes packed into a number, which also covers languages that inflect.
Fitting sees at most ``max_rows`` labelled documents, those of the smallest hashes of their ids. That bounds the lexicon,
too, which has every term of at least ``min_docs`` toxic documents and ``min_weight``. Every document is scored.

Defined cases: null and empty texts have only zero features and are scored like any other; labels that are null are
left out; with fewer than two documents of a label there is no model and every score is the share of toxic rows (0 without
rows); a document with several label rows counts once for each, in one fold; an empty table gives no rows. Columns not named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import broadcast_if_small
from .words import ALPHANUMERIC, CHUNK, LOWER, NOT_SPACE, Words, mix, slices, split_words

#: Second-person words of the languages at hand.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vuestro tus".split()
#: Signs and digits that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
LENGTHS = (4, 5, 6, 8)
NEAR = 5
FEATURES = (
    "log_words", "term_density", "log_terms", "weight_density", "weight_sum", "max_weight", "near_density", "log_near", "second_density",
    "upper_share", "shout_share", "exclamation_rate", "question_rate", "mark_rate", "spelled_share", "spelled_terms", "digit_share",
)


@dataclass(frozen=True)
class Settings:
    max_rows: int = 40_000
    folds: int = 3
    min_docs: int = 3
    min_weight: float = 1.5
    trees: int = 20
    depth: int = 3
    threshold: float = 0.3


def _normal_table() -> np.ndarray:
    table = LOWER.copy()
    for sign, letter in STAND_INS.items():
        table[ord(sign)] = ord(letter)
    return table


STANDING = _normal_table()
IS_STAND_IN = np.isin(np.arange(256), [ord(c) for c in STAND_INS])
IS_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
IS_UPPER = np.isin(np.arange(256), range(65, 91))
IS_MARK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()-", dtype=np.uint8))


def packed_beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
    """Keys of the first L bytes of each word, 0 where it is shorter. Keys of different lengths never meet by design."""
    value, out, last = np.zeros(len(starts), dtype=np.uint64), {}, max(0, len(data) - 1)
    for j in range(max(LENGTHS)):
        inside = starts + j < ends
        byte = np.where(inside, data[np.minimum(starts + j, last)], 0).astype(np.uint64) if len(data) else value
        value = (value << np.uint64(8)) | byte
        if j + 1 in LENGTHS:
            out[j + 1] = np.where(inside, mix(mix(value) + np.uint64(j + 1)), np.uint64(0))
    return out


def term_keys(words: Words) -> list[np.ndarray]:
    """Keys of each word's terms: the word itself and its beginnings."""
    return [words.hashes, *packed_beginnings(words.data, words.starts, words.ends).values()]


def _text(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))


TERM = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("fold", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])


def term_documents(labelled: DataFrame) -> DataFrame:
    """``toxic, fold, key, n``: in how many documents of a label and fold a term is, in parts."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                words = split_words(batch.column("text"), ALPHANUMERIC, lower=True)
                groups: dict[tuple[int, int], list] = {}
                keys = term_keys(words)
                for d, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                    own = np.unique(np.concatenate([k[a:b] for k in keys]))
                    groups.setdefault((batch.column("toxic")[d].as_py(), batch.column("fold")[d].as_py()), []).append(own[own != 0])
                for (label, fold), found in groups.items():
                    own, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(own), label, dtype=np.int32)), pa.array(np.full(len(own), fold, dtype=np.int32)), pa.array(own.view(np.int64)), pa.array(n.astype(np.int64)),
                    ], names=TERM.names)

    return labelled.select("toxic", "fold", "text").mapInArrow(run, TERM)


Lexicon = tuple[np.ndarray, np.ndarray]


def fit_lexicons(labelled: DataFrame, settings: Settings) -> list[Lexicon]:
    """Sorted keys and weights of the terms that speak for toxicity: without fold 0, without fold 1, ..., and of all.

    A weight is a log odds ratio less its standard error.
    """
    sizes = {(r["toxic"], r["fold"]): r["n"] for r in labelled.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [[f for f in range(settings.folds) if f != left] for left in range(settings.folds + 1)]
    counted = [F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"n{y}_{f}") for y in (0, 1) for f in range(settings.folds)]
    terms, weights = term_documents(labelled).groupBy("key").agg(*counted), []
    for folds in chosen:
        n_toxic, n_clean = (sum(sizes.get((y, f), 0) for f in folds) for y in (1, 0))
        toxic = sum((F.col(f"n1_{f}") for f in folds), F.lit(0))
        t, c = toxic + 0.5, sum((F.col(f"n0_{f}") for f in folds), F.lit(0)) + 0.5
        odds = F.log(t / (n_toxic + 1 - t)) - F.log(c / (n_clean + 1 - c))
        error = F.sqrt(1 / t + 1 / (n_toxic + 1 - t) + 1 / c + 1 / (n_clean + 1 - c))
        usable = (toxic >= settings.min_docs) & (t < n_toxic + 1) & (c < n_clean + 1)
        weights.append(F.when(usable & (odds - error >= settings.min_weight), odds - error))
    found = terms.select("key", *[w.alias(f"w{i}") for i, w in enumerate(weights)])
    rows = found.filter(F.coalesce(*[f"w{i}" for i in range(len(weights))]).isNotNull()).toArrow()
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    out = []
    for i in range(len(weights)):
        w = rows.column(f"w{i}").to_numpy(zero_copy_only=False).astype(float)[order]
        out.append((keys[order][~np.isnan(w)], w[~np.isnan(w)]))
    return out


def term_weights(words: Words, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The largest weight among each word's terms, 0 for none."""
    keys, weights = lexicon
    out = np.zeros(len(words.hashes))
    if len(keys):
        sieve = np.zeros(1 << 16, dtype=bool)
        sieve[keys >> np.uint64(48)] = True
        for own in term_keys(words):
            at = np.flatnonzero(sieve[own >> np.uint64(48)])
            place = np.minimum(np.searchsorted(keys, own[at]), len(keys) - 1)
            out[at] = np.maximum(out[at], np.where(keys[place] == own[at], weights[place], 0.0))
    return out


def feature_matrix(column: pa.Array, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    words = split_words(column, ALPHANUMERIC, lower=True)
    raw = split_words(column, NOT_SPACE)
    n_docs, n, data, offsets = len(words), words.counts(), raw.data, raw.offsets
    of_word = np.repeat(np.arange(n_docs), n)
    weight = term_weights(words, lexicon)
    hit = weight > 0

    def total(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=n_docs)

    pronouns = split_words(pa.array(SECOND_PERSON), ALPHANUMERIC, lower=True).hashes
    second = np.isin(words.hashes, pronouns)
    # Second-person words within NEAR words, without crossing a document's edge.
    sums = np.concatenate([[0], np.cumsum(second)])
    at = np.flatnonzero(hit)
    low = np.maximum(at - NEAR, words.first[:-1][of_word[at]])
    high = np.minimum(at + NEAR + 1, words.first[1:][of_word[at]])
    near = np.zeros(len(hit))
    near[at] = sums[high] > sums[low]

    byte_sums = {name: np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(flags, dtype=np.int32)]) for name, flags in (
        ("letter", IS_LETTER[data]), ("upper", IS_UPPER[data]), ("mark", IS_MARK[data]), ("!", data == 33), ("?", data == 63),
        ("digit", (data >= 48) & (data <= 57)), ("stand", IS_STAND_IN[data]),
    )}
    per_doc = {k: np.diff(s[offsets]).astype(float) for k, s in byte_sums.items()}
    in_word = {k: s[raw.ends] - s[raw.starts] for k, s in byte_sums.items() if k in ("letter", "upper", "stand")}
    raw_of, raw_n = np.repeat(np.arange(n_docs), raw.counts()), np.maximum(raw.counts(), 1)
    shout = (in_word["upper"] >= 3) & (in_word["upper"] == in_word["letter"])
    # A stand-in counts inside a word: letters before and after it.
    inner = byte_sums["stand"][np.maximum(raw.ends - 1, raw.starts)] - byte_sums["stand"][np.minimum(raw.starts + 1, raw.ends)] if len(data) else in_word["stand"]
    spelled = (inner > 0) & (in_word["letter"] >= 2)
    spelled_hit = np.zeros(len(spelled))
    if spelled.any():
        chosen = np.flatnonzero(spelled)
        texts = [STANDING[data[s:e]].tobytes().decode("utf-8", "replace") for s, e in zip(raw.starts[chosen], raw.ends[chosen], strict=True)]
        plain = split_words(pa.array(texts), ALPHANUMERIC, lower=True)
        spelled_hit[chosen] = np.bincount(np.repeat(np.arange(len(texts)), plain.counts()), weights=term_weights(plain, lexicon) > 0, minlength=len(texts)) > 0
    hits, nearby, weights, size = total(hit, of_word), total(near, of_word), total(weight, of_word), np.maximum(n, 1)
    largest = np.zeros(n_docs)
    np.maximum.at(largest, of_word[at], weight[at])
    chars = np.maximum(np.diff(offsets), 1)
    return np.stack([
        np.log1p(n), hits / size, np.log1p(hits), weights / size, weights, largest, nearby / size, np.log1p(nearby), total(second, of_word) / size,
        per_doc["upper"] / np.maximum(per_doc["letter"], 1), total(shout, raw_of) / raw_n, per_doc["!"] / chars, per_doc["?"] / chars, per_doc["mark"] / chars,
        total(spelled, raw_of) / raw_n, np.log1p(total(spelled_hit, raw_of)), per_doc["digit"] / chars,
    ], axis=1)


def with_features(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray], text: str) -> DataFrame:
    """``docs`` plus the array ``features``. ``lexicon`` is broadcast; its terms are among those of ``max_rows`` texts.

    Only the text goes to Python and only the features come back; the other columns stay where they are.
    """
    known = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def features(column: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([column], names=["text"])
        matrix = np.concatenate([np.zeros((0, len(FEATURES))), *[feature_matrix(b.column("text"), known.value) for b in slices(whole, "text", 4 * CHUNK)]])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * len(FEATURES), pa.int32()), pa.array(matrix.reshape(-1)))

    return docs.withColumn("features", features(text))


def remainder(doc: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4: 2, and a null id, is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(4)), F.lit(2))


@dataclass(frozen=True)
class Model:
    lexicon: tuple[np.ndarray, np.ndarray]
    trees: object | None
    calibration: object | None
    prior: float

    def score(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """``doc_id, score`` for every row."""
        if self.trees is None:
            return _text(docs, doc, text).select("doc_id", F.lit(self.prior).alias("score"))
        raw = _raw(self.trees, with_features(_text(docs, doc, text), self.lexicon, "text").drop("text"))
        return self.calibration.transform(raw).select("doc_id", F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def _raw(trees, frame: DataFrame) -> DataFrame:
    scored = trees.transform(frame.withColumn("vector", array_to_vector("features")))
    return scored.withColumn("raw", vector_to_array("probability")[1]).drop("vector", "features", "rawPrediction", "probability", "prediction")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the labelled rows that are not held out."""
    known = labels.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("toxic")).filter("toxic IN (0, 1)").filter(remainder("doc_id") != 2)
    # A bounded number of documents, and their folds: dealt in turn within each label.
    few = known.groupBy("doc_id").agg(F.max("toxic").alias("any")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    turn = F.row_number().over(W.partitionBy("any").orderBy(F.xxhash64("doc_id"), "doc_id"))
    few = materialise(few.select("doc_id", (turn % settings.folds).cast("int").alias("fold")).join(known, "doc_id"), "learnable")
    labelled = materialise(_text(docs, doc, text).join(broadcast_if_small(few), "doc_id"), "labelled")
    seen = {r["toxic"]: r for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.min("fold").alias("low"), F.max("fold").alias("high")).collect()}
    total = sum(r["n"] for r in seen.values())
    if len(seen) < 2 or any(r["low"] == r["high"] for r in seen.values()):
        return Model((np.zeros(0, dtype=np.uint64), np.zeros(0)), None, None, seen[1]["n"] / total if 1 in seen else 0.0)
    lexicons = fit_lexicons(labelled, settings)
    parts = [with_features(labelled.filter(F.col("fold") == f), lexicons[f], "text").select("toxic", "fold", "features") for f in range(settings.folds)]
    rows = materialise(reduce(DataFrame.unionByName, parts).withColumn("vector", array_to_vector("features")).withColumn("toxic", F.col("toxic").cast("double")), "training")
    grown = GBTClassifier(labelCol="toxic", featuresCol="vector", predictionCol="prediction", maxIter=settings.trees, maxDepth=settings.depth, maxBins=64, stepSize=0.2, seed=11)
    unseen = [_raw(grown.fit(rows.filter(F.col("fold") != f)), rows.filter(F.col("fold") == f).drop("vector")).select("toxic", "raw") for f in range(settings.folds)]
    pooled = materialise(reduce(DataFrame.unionByName, unseen), "unseen_scores")
    calibration = IsotonicRegression(labelCol="toxic", featuresCol="raw", predictionCol="score").fit(pooled)
    return Model(lexicons[-1], grown.fit(rows), calibration, seen[1]["n"] / total)


def remove_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold.

    Features ride along with the rows, so nothing is joined back and rows without an id are judged too.
    """
    model = fit(docs, labels, settings, doc, text)
    if model.trees is None:
        return docs.limit(0) if model.prior >= settings.threshold else docs
    # The columns of the input are out of the way of those that scoring adds.
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    raw = _raw(model.trees, with_features(nested, model.lexicon, f"_doc.`{text}`"))
    return model.calibration.transform(raw).filter(F.col("score") < settings.threshold).select("_doc.*")
