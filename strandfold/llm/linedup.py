"""Repeated line runs by distributed prefix doubling over line-id sequences.

A document is the sequence of its lines with a word; a line's id is a 128-bit hash. Doubling names the runs of 1, 2, 4,
... lines at every position: a run of 2h lines is named by the names of its two halves, joined from the position h lines
on. Positions whose run occurs once are dropped at once, since nothing longer can repeat there. The suffixes that share a
name of depth h are one interval of common prefix at least h in the suffix array; an interval of any depth d between h
and 2h has the name of its first h lines with that of its last h lines. Only membership in intervals decides what is
deleted, so names are hashes rather than ordinals and no order has to be sorted out inside an interval.

A repeated run counts if it has at least ``min_words`` words. At each position the shortest run of enough words that
starts there, and the shortest that ends there, are looked up; in their interval all but the earliest occurrence (by
doc_id, row, line) are deleted. These runs cover exactly the maximal repeated runs: a line of such a run either has
enough words from it to the run's end, or lies in the shortest run that ends there.

All steps are DataFrame expressions. A line, run or passage of any frequency is counted with partial sums; rows of a
hot interval are joined to its single earliest row, which Spark splits.

Defined cases: null and empty texts have no lines; lines without a word are kept and do not interrupt a run; rows with
equal ids are told apart by their place in the stored table; null ids come first; runs inside one document count too,
overlapping ones included; an empty table gives no rows. Columns of the input named _row or _gone
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50


def _shortest(words: Column, least: int) -> Column:
    """How many leading elements of ``words`` have the sum ``least``; null if all have not."""
    zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(a.s >= least, a).otherwise(F.struct((a.s + x).alias("s"), (a.n + 1).alias("n")))
    return F.aggregate(words, zero, step, lambda a: F.when(a.s >= least, a.n))


def line_sequences(docs: DataFrame, doc: str, text: str, min_words: int, row: str | None = None) -> DataFrame:
    """``row, doc_id, at, line, a, b, ahead, back`` per line with a word, stored; a text without one has a row of nulls.

    ``at`` counts such lines, ``line`` all; (a, b) is the line's id; ``ahead`` and ``back`` are the lengths of the
    shortest runs of ``min_words`` words that start and end there.
    """
    lines = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("text"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    kept = F.transform(F.filter(lines, lambda x: x.words > 0), lambda x: F.struct(
        x.line.alias("line"), F.xxhash64(x.text).alias("a"), F.xxhash64(F.lit(1), x.text).alias("b"), x.words.alias("words")
    ))
    base = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(doc).cast("bigint").alias("doc_id"), kept.alias("lines"))
    base = base.withColumn("w", F.col("lines.words"))
    # Every line has a word, so a run of enough words has at most min_words lines.
    ahead = F.transform("lines", lambda x, i: _shortest(F.slice("w", i + 1, min_words), min_words))
    start = lambda i: F.greatest(i + 2 - min_words, F.lit(1))
    back = F.transform("lines", lambda x, i: _shortest(F.reverse(F.slice("w", start(i), i + 2 - start(i))), min_words))
    zipped = F.arrays_zip("lines", ahead.alias("ahead"), back.alias("back"))
    flat = base.select("row", "doc_id", F.posexplode_outer(zipped).alias("at", "x"))
    return materialise(flat.select(
        "row", "doc_id", "at", F.col("x.lines.line").alias("line"), F.col("x.lines.a").alias("a"), F.col("x.lines.b").alias("b"), F.col("x.ahead").alias("ahead"), F.col("x.back").alias("back")
    ), "line_sequences")


def _repeated(named: DataFrame) -> DataFrame:
    """Rows whose name (a, b) occurs more than once, stored."""
    often = materialise(named.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b"), "repeated_names")
    return materialise(named.join(broadcast_if_small(often), ["a", "b"], "left_semi"), "repeated")


def double(named: DataFrame, h: int) -> DataFrame:
    """Names of runs of 2h lines from names of runs of h lines: row, at, a, b."""
    later = named.select("row", (F.col("at") - h).alias("at"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    joined = named.join(later, ["row", "at"])
    return joined.select("row", "at", F.xxhash64("a", "a2").alias("a"), F.xxhash64("b", "b2", F.lit(h)).alias("b"))


def later_copies(sequences: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row, at, length`` of every shortest run that occurs earlier too."""
    forward = sequences.filter("ahead IS NOT NULL").select("row", "doc_id", "at", F.col("ahead").alias("length"))
    backward = sequences.filter("back IS NOT NULL").select("row", "doc_id", (F.col("at") - F.col("back") + 1).alias("at"), F.col("back").alias("length"))
    names, h, found = _repeated(sequences.filter("at IS NOT NULL").select("row", "at", "a", "b")), 1, None
    while True:
        # Lengths from h to 2h - 1 are named by their first and last h lines.
        now = forward.filter(f"length >= {h} AND length < {2 * h}").unionByName(backward.filter(f"length >= {h} AND length < {2 * h}"))
        first = names.select("row", "at", "a", "b")
        runs = now.join(first, ["row", "at"])
        last = names.select("row", F.col("at").alias("end"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        runs = runs.withColumn("end", F.col("at") + F.col("length") - h).join(last, ["row", "end"]).drop("end").distinct()
        found = runs if found is None else found.unionByName(runs)
        h *= 2
        if h > min_words:
            break
        names = _repeated(double(names, h // 2))
        if not names.limit(1).count():
            break
    found = materialise(found, "runs")
    key, place = ["length", "a", "b", "a2", "b2"], F.struct("doc_id", "row", "at")
    intervals = found.groupBy(*key).agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    intervals = materialise(intervals.drop("n"), "intervals")
    joined = found.join(broadcast_if_small(intervals, 200_000), key)
    return joined.filter((F.col("row") != F.col("earliest.row")) | (F.col("at") != F.col("earliest.at"))).select("row", "at", "length")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Per row: ``row, doc_id, n_lines`` (with a word) and the sorted ``deleted_lines`` (counted from 0, all lines).

    ``row`` names a column of unique row numbers, if there is one.
    """
    sequences = line_sequences(docs, doc, text, min_words, row)
    copies = later_copies(sequences, min_words)
    at = copies.select("row", F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("at")).distinct().withColumn("gone", F.lit(True))
    marked = sequences.select("row", "doc_id", "at", "line").join(at, ["row", "at"], "left")
    return marked.groupBy("row", "doc_id").agg(
        F.count("line").alias("n_lines"), F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("line")))).alias("deleted_lines")
    )


def remove_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines of later copies taken out of the texts. Rows are stored once, so that they keep their number."""
    stored = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = deleted_lines(stored, min_words, doc, text, "_row").filter(F.size("deleted_lines") > 0)
    gone = materialise(found.select(F.col("row").alias("_row"), F.col("deleted_lines").alias("_gone")), "deleted")
    lines = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains("_gone", i))
    joined = stored.join(broadcast_if_small(gone, 100_000), "_row", "left")
    return joined.withColumn(text, F.when(F.col("_gone").isNotNull(), F.array_join(lines, "\n")).otherwise(F.col(text))).select(*docs.columns)
