"""Raking against the plain algorithm, and the draw."""

import numpy as np

import corpus_pipeline
from strandfold.llm import mixing as mx


def plain_rake(cells, targets, rounds=500):
    weight = np.array([t for *_, t in cells], dtype=float)
    weight /= weight.sum()
    for _ in range(rounds):
        for d, wanted in enumerate(targets):
            for value, share in wanted.items():
                own = np.array([c[d] == value for c in cells])
                if weight[own].sum():
                    weight[own] *= share / weight[own].sum()
    return weight


def test_rake_equals_plain_algorithm(spark):
    draw = np.random.default_rng(3)
    cells = [(s, g, t, int(draw.integers(1, 1000))) for s in "abcd" for g in ("en", "de", "") for t in ("x", "y") if draw.random() < 0.85]
    targets = [{"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, {"en": 0.5, "de": 0.3, "": 0.2}, {"x": 0.6, "y": 0.4}]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    given = {d: spark.createDataFrame(list(t.items()), "value string, target double") for d, t in zip(mx.DIMENSIONS, targets, strict=True)}
    got = {tuple(r[d] for d in mx.DIMENSIONS): r["weight"] for r in mx.rake(frame, given, tolerance=1e-10).collect()}
    for cell, weight in zip(cells, plain_rake(cells, targets), strict=True):
        assert abs(got[cell[:3]] - weight) < 1e-6


def test_targets_for_absent_values_are_spread(spark):
    frame = spark.createDataFrame([("a", "en", "x", 10), ("b", "en", "x", 30), ("c", "en", "x", 0)], "source string, lang string, topic string, tokens long")
    given = {"source": spark.createDataFrame([("a", 1.0), ("b", 1.0), ("gone", 2.0)], "value string, target double")}
    got = {r["source"]: r["weight"] for r in mx.rake(frame, given).collect()}
    assert abs(got["a"] - 0.5) < 1e-9 and abs(got["b"] - 0.5) < 1e-9 and "c" not in got


def test_sample_follows_targets(spark):
    rows = [(i, f"word number {i} of a text", None if i % 50 == 0 else "en", "big" if i % 4 else "small") for i in range(8000)] + [(9001, None, "en", "big"), (None, "no id here", "de", None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, sampled string")
    targets = {"source": spark.createDataFrame([("big", 0.5), ("small", 0.5), ("", 0.0)], "value string, target double")}
    got = mx.sample_by_weight(docs, targets).collect()
    assert len(got) == len(rows)
    kept = {s: [r for r in got if r["source"] == s and r["sampled"]] for s in ("big", "small")}
    assert len(kept["small"]) == 2000 and abs(len(kept["big"]) - 2000) < 150
    half = sum(r["n_tokens"] for r in mx.sample_by_weight(docs, targets, keep_tokens=12_000).collect() if r["sampled"])
    assert abs(half - 12_000) < 1_000
    assert mx.sample_by_weight(docs.limit(0)).count() == 0
    again = {r["doc_id"] for r in mx.sample_by_weight(docs.repartition(7), targets).collect() if r["sampled"]}
    assert again == {r["doc_id"] for r in got if r["sampled"]}


def test_pipeline_mixes_a_large_source_down(spark):
    # Of equal documents, 6,000 against 100: rates are as 60^(0.9 - 1). At the power 0.97, 88 of 100 large ones stayed.
    rows = [(i, "the same words in every text", "en", "small" if i % 61 == 0 else "large") for i in range(6100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = [r["source"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    assert kept.count("small") == 100 and abs(kept.count("large") / 6000 - 60 ** (0.9 - 1)) < 0.03
