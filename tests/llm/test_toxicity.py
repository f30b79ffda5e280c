"""Toxicity on a planted corpus: held-out accuracy and edge cases."""

import random

import numpy as np
import pyarrow as pa

from strandfold.llm import toxicity as tx

NO_TERMS = (np.zeros(0, dtype=np.uint64), np.zeros(0))


def planted(n=1200):
    draw = random.Random(4)
    plain = ["lorem", "ipsum", "dolor", "amet", "sed", "vita", "terra", "lumen"]
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(plain) + draw.choice(["", "", "us", "um"]) for _ in range(draw.randrange(5, 60))]
        toxic = draw.random() < 0.25
        if toxic:
            for _ in range(draw.randrange(1, 4)):
                words.insert(draw.randrange(len(words)), draw.choice(["grumbo", "zorkling" + draw.choice(plain), "you Blarg!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = planted()
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in [*rows, (5000, None), (5001, ""), (None, "grumbo you grumbo"), (5002, "dolor " * 50_000)]], "doc_id long, text string, features string, score double")
    known = spark.createDataFrame([*labels, (7000, 1), (5000, None)], "doc_id long, toxic int")
    model = tx.fit(docs, known)
    scores = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    held = {r["doc_id"] for r in docs.filter(tx.remainder() == 2).collect()} - {None}
    right = [(scores[i] >= 0.3) == bool(y) for i, y in labels if i in held]
    assert len(right) > 200 and sum(right) / len(right) > 0.97
    assert len(scores) == len(rows) + 4 and all(0 <= s <= 1 for s in scores.values())
    kept = tx.remove_toxic(docs, known)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {5000, 5001, 5002} <= ids and None not in ids
    caught = sum(i not in ids for i, y in labels if y) / sum(y for _, y in labels)
    assert caught > 0.95 and sum(i in ids for i, y in labels if not y) == sum(not y for _, y in labels)


def test_degenerate_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in tx.fit(docs, none).score(docs).collect()} == {0.0}
    assert tx.remove_toxic(docs, none).count() == 2
    assert tx.fit(docs.limit(0), none).score(docs.limit(0)).count() == 0


def test_features():
    found = dict(zip(tx.FEATURES, tx.feature_matrix(pa.array(["you are BAD, gr4mbo! yes?"]), NO_TERMS)[0], strict=True))
    assert found["second_density"] == 1 / 5 and found["shout_share"] == 1 / 5 and found["spelled_share"] == 1 / 5
    assert found["exclamation_rate"] == 1 / 25 and found["question_rate"] == 1 / 25 and found["term_density"] == 0
    assert (tx.feature_matrix(pa.array([None, ""]), NO_TERMS) == 0).all()
