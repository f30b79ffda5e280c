"""Benchmark windows against brute force; removal of documents and spans."""

import re

import pytest

from strandfold.llm import decontaminate as dc

DOCS = "doc_id long, text string, n_words string, extra int"
ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, None), (4, " -- "),
    (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa other end"), (2, "short item"),
]
TEXT = "Before ALPHA, beta gamma delta! epsilon zeta eta theta iota kappa lambda mu after"


def rows():
    return [
        (1, TEXT, "x", 1), (2, "alpha beta gamma delta epsilon zeta eta theta iota", "x", 2), (3, None, None, None), (4, "", "y", 0),
        (5, "a short  item and a SHORT-item", "z", 5), (1, TEXT, "x", 1), (None, "short item", "q", 9), (7, "word " * 30_000 + "short item", "l", 1),
    ]


def brute(text, items, width=10):
    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = lower(text), set(), set()
    for item, passage in items:
        own = lower(passage)
        k = min(width, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_scan_equals_brute_force(spark, block_bytes):
    docs, items = spark.createDataFrame(rows(), DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.scan(docs, items, block_bytes=block_bytes).select("doc_id", "text", "n_words", dc.hit_words().alias("hit"), "item_ids", "extra").collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r["n_words"], r["hit"], list(r["item_ids"])) == brute(r["text"], ITEMS)


def test_removal(spark):
    docs, items = spark.createDataFrame(rows(), DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = dc.decontaminate(docs.select("doc_id", "text", "extra"), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    spans = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs.select("doc_id", "text", "extra"), items, remove="spans").collect()}
    assert spans[1] == "Before  after" and spans[5] == "a  and a " and spans[2] == rows()[1][1] and spans[3] is None


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(rows(), DOCS), spark.createDataFrame([], "item_id long, text string")
    assert dc.scan(docs, none).filter("size(hit_spans) > 0").count() == 0
    assert dc.scan(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
