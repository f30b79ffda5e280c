"""The pipeline's near-duplicate stage against all pairs at a similarity of 0.8."""

import random

from test_neardup import shingles

import corpus_pipeline


def kept_by_all_pairs(rows, percent):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d for d, _ in sets if find(d) == d}


def near_copies(seed, n):
    """Pairs at similarities on both sides of 0.80 and 0.85: a run of new words at the end of a text of 204 words."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        words = [f"w{draw.randrange(10**6)}" for _ in range(204)]
        # With c of 200 shingles changed, the similarity is (200 - c) / (200 + c); 0.80 at c = 22.2, 0.85 at c = 16.2.
        c = 12 + i % 16
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 204 - c] + [f"n{i}x{j}" for j in range(c)]))]
    draw.shuffle(rows)
    return rows


def test_near_duplicates_stage_equals_all_pairs(spark):
    rows = near_copies(3, 160)
    want = kept_by_all_pairs(rows, 80)
    assert want != kept_by_all_pairs(rows, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == want


def test_bands_are_sized_for_the_threshold():
    s = corpus_pipeline.NEAR
    assert s.percent == 80 and (1 - (s.percent / 100) ** s.rows) ** s.bands < 1e-6
