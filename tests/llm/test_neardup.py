"""Near-duplicate groups against all pairs."""

import random
import re

import numpy as np

from strandfold.llm import neardup as nd


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {(d, len(s)): find(d) for d, s in sets}


def corpus(seed, n):
    """Chains and clusters around a few texts, at all distances from the threshold."""
    draw, rows = random.Random(seed), []
    bases = [[f"w{draw.randrange(5000)}" for _ in range(120)] for _ in range(4)]
    for i in range(n):
        words = list(draw.choice(bases) if i % 3 else bases[0])
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5, 9])):
            words[draw.randrange(len(words))] = f"n{draw.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(i, f"unique text number {i} about {i * 7} things and {i * 13} more") for i in range(1, 40)]
    rows += [(60, "Two words"), (61, "two  WORDS"), (62, ""), (63, None), (64, " \n "), (65, rows[0][1]), (66, rows[0][1].upper())]
    draw.shuffle(rows)
    return rows


def test_groups_equal_all_pairs(spark):
    rows = corpus(5, 260)
    want = brute(rows)
    for block in (8, 256):
        got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), nd.Settings(block=block)).collect()
        assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_deduplicate_with_repeated_rows_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long, "b"), (1, long, "a"), (1, long, "a"), (None, long, "n"), (7, "other words that stand alone here", "c"), (7, "yet another text of the same id", "d"), (9, None, "e"), (10, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = nd.deduplicate(docs).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in kept) == [(0, "n"), (1, "a"), (7, "c"), (7, "d"), (9, "e"), (10, "f")]
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_posterior_bounds():
    s = nd.Settings()
    draw = np.random.default_rng(1)
    for n, m in zip(range(32, 97, 32), nd.least_matches(s), strict=True):
        beta = draw.beta(m + 1, n - m + 1, 200_000)
        assert 0 < m < 0.85 * n and (beta >= 0.85).mean() < 1e-3
    a = draw.integers(0, 1 << 16, (500, 96)).astype("<u2")
    b = np.where(draw.random((500, 96)) < 0.86, a, 0).astype("<u2")
    assert nd.survives(a, b, s).all() and not nd.survives(a, np.roll(a, 1, axis=0), s).any()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in nd.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
