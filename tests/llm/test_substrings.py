"""Substring removal against brute force, tree by tree and as a whole."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandfold.llm import substrings as ss


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    """Per row the removed word numbers."""
    least = {}
    for doc, text in rows:
        w = words_of(text)
        for i in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[i : i + window])
                least[key] = min(least.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w, gone = words_of(text), set()
        for i in range(len(w) - window + 1):
            if doc is not None and least[tuple(w[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        out.append(gone)
    return out


def corpus(seed, window):
    draw = random.Random(seed)
    fresh = lambda n: [f"w{draw.randrange(30)}" for _ in range(n)]
    passages = [fresh(draw.choice([window - 1, window, window + 3, 3 * window])) for _ in range(5)]
    rows = []
    for i in range(70):
        parts = [draw.choice([fresh(draw.randrange(0, 2 * window)), draw.choice(passages)]) for _ in range(draw.randrange(0, 4))]
        if i % 11 == 0:
            parts.append(["same"] * draw.randrange(window, 3 * window))
        rows.append((draw.choice([None, 7, 8]) if i % 13 == 0 else 200 - i, draw.choice([" ", "\n", " \t "]).join(x for p in parts for x in p)))
    return rows + [(1, None), (2, ""), (3, " \n "), (4, " ".join(passages[3])), (5, " ".join(passages[3])), rows[5], rows[5], (6, " ".join(fresh(4000) + passages[2] + passages[2]))]


@pytest.mark.parametrize("seed, settings", [
    (1, ss.Settings(10, 4)), (2, ss.Settings(10, 10)), (3, ss.Settings(12, 1)), (4, ss.Settings(10, 4, largest=3)), (5, ss.Settings(10, 4, largest=0)), (6, ss.Settings()), (7, ss.Settings(10, 4, largest=12)),
])
def test_removed_words_equal_brute_force(spark, seed, settings):
    rows = corpus(seed, settings.window)
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, at long")
    got = {r["at"]: r["judged"] for r in ss.judge(docs, settings).collect()}
    for i, gone in enumerate(brute(rows, settings.window)):
        w = words_of(rows[i][1])
        assert got[i]["n_words"] == len(w) and got[i]["n_removed"] == len(gone)
        assert got[i]["kept"] == " ".join(x for j, x in enumerate(w) if j not in gone)
        spans = got[i]["spans"]
        assert {j for a, b in zip(spans[::2], spans[1::2], strict=True) for j in range(a, b)} == gone and spans == sorted(spans)


def test_equal_windows_have_equal_anchors():
    import pyarrow as pa

    draw, settings = random.Random(9), ss.Settings(20, 5)
    passage = " ".join(f"w{draw.randrange(4)}" for _ in range(60))
    words = ss.split_words(pa.array([f"a b c {passage} x", f"{passage} y y y", "z " + passage]))
    found = ss.anchors(words, settings)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(found.low, found.high, strict=True)])
    assert sorted(covered.tolist()) == np.flatnonzero(words.full(20)).tolist()
    anchor = {int(p): int(at) - int(p) for a, b, at in zip(found.low, found.high, found.at, strict=True) for p in range(a, b + 1)}
    bases = [words.first[0] + 3, words.first[1], words.first[2] + 1]
    assert all(len({anchor[int(b) + i] for b in bases}) == 1 for i in range(41))


def test_nodes_of_a_suffix_tree():
    rows = np.array([[1, 2, 3], [1, 2, 4], [9, 9, 9], [1, 2, 3], [1, 5, 3]], dtype=np.uint64)
    tree = ss.suffix_tree(rows)
    for depth in range(4):
        node = ss.nodes(tree, depth)
        for i in range(5):
            for j in range(5):
                assert (node[i] == node[j]) == (rows[i, :depth] == rows[j, :depth]).all()


def test_texts_clashing_columns_and_empty_tables(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"first  {passage}\nend", "r", 1), (2, f"other\n\n{passage}   last", "s", 2), (3, None, "t", 3), (4, "kept\tas  it is", "u", 4), (None, passage, "v", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, judged long").withColumn("marks", F.col("row")).withColumn("text_key", F.lit(0))
    got = {r["judged"]: r for r in ss.remove_repeats(docs).collect()}
    assert [got[i]["text"] for i in range(1, 6)] == [rows[0][1], "other last", None, rows[3][1], passage]
    assert all(got[i]["row"] == got[i]["marks"] == rows[i - 1][2] for i in got)
    assert ss.remove_repeats(docs.limit(0)).count() == 0 and ss.judge(docs.limit(0)).count() == 0
    assert ss.judge(docs).columns == ["doc_id", "text", "row", "marks", "text_key", "judged"]
