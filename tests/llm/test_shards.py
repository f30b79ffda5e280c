"""Minimax cuts against the search over all groups."""

import random
import zlib

import pytest

from strandfold.llm import shards as sh


def brute_capacity(sizes, shards):
    low, high = -(-sum(sizes) // shards), sum(sizes)
    while low < high:
        middle, used, filled = (low + high) // 2, 1, 0
        feasible = max(sizes) <= middle
        for s in sizes:
            used, filled = (used + 1, s) if filled + s > middle else (used, filled + s)
        low, high = (low, middle) if feasible and used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("seed,n,shards", [(1, 5, 3), (2, 200, 7), (3, 3000, 16), (4, 1, 4), (5, 40, 40)])
def test_cuts_are_minimax(spark, seed, n, shards):
    draw = random.Random(seed)
    keys = sorted(draw.sample(range(1 << sh.KEY_BITS), n - n // 3)) + [(7 << 50) + i for i in range(n // 3)]
    groups = sorted({k: draw.choice([1, 10, 500, 100_000 if draw.random() < 0.02 else 3]) for k in keys}.items())
    cuts = sh.plan_cuts(spark.createDataFrame(groups, "key long, size long"), shards)
    loads = [0] * shards
    for key, size in groups:
        loads[sum(key >= c for c in cuts)] += size
    assert max(loads) == brute_capacity([s for _, s in groups], shards)


def test_assignment_and_slots(spark):
    texts = [f"text {i} é" for i in range(300)] + ["copy"] * 200 + [None, "", None]
    rows = [(i if i != 7 else None, t, "clash") for i, t in enumerate(texts)] + [(5, texts[5], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string").repartition(6)
    got = sh.number_slots(sh.assign_shards(docs, 16)).collect()
    assert len(got) == len(rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in got)
    where = {}
    for r in got:
        assert where.setdefault(r["text"] or "", r["shard"]) == r["shard"]
    for s in range(16):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert zlib.crc32(b"") == 0


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sh.number_slots(sh.assign_shards(docs, 16)).count() == 0
    sh.write_shards(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
