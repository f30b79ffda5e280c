"""Centroid clustering against plain Python, and the bounds against exact distances."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandfold.llm import centroids as cc

SMALL = cc.Settings(clusters=4, rounds=2, dimensions=3, pivots=4, candidates=16)


def plain(rows, s):
    """(vec_id, cluster, distance) in the order of the kept rows, and the centroids."""
    kept = [(i, tuple(math.floor(s.scale * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == s.dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [v for _, v in first[: s.clusters]]
    far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(at))
    for _ in range(s.rounds):
        own = [[v for _, v in kept if far(v)[1] == n] for n in range(len(at))]
        at = [tuple(sum(x) // len(vs) for x in zip(*vs, strict=True)) if vs else c for vs, c in zip(own, at, strict=True)]
    return sorted(((i, far(v)[1], far(v)[0]) for i, v in kept), key=repr), at


def vectors(seed, n=120):
    draw = random.Random(seed)
    rows = [(i, [draw.gauss(draw.choice([-2, 0, 3]), 0.3) for _ in range(3)]) for i in range(n)]
    same = rows[7][1]
    return rows + [(500 + i, same) for i in range(60)] + [(7, same), (None, [0.5, 0.5, -0.5]), (900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 0.0]), (904, [float("inf"), 0.0, 0.0]), (905, [])]


@pytest.mark.parametrize("seed, settings", [(1, SMALL), (2, SMALL), (3, cc.Settings(clusters=9, rounds=3, dimensions=3, pivots=1)), (4, cc.Settings(clusters=300, rounds=1, dimensions=3))])
def test_clusters_equal_plain_python(spark, seed, settings):
    rows = vectors(seed)
    found = cc.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), settings)
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, at = plain(rows, settings)
    assert [tuple(c) for c in found.centroids.tolist()] == at
    got = found.described().collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=repr) == want
    total = sum(w[2] for w in want)
    assert all(r["inertia"] == total and r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"]) for r in got)
    assert {r["cluster"]: r["centroid_sha256"] for r in got} == {c: found.hashes()[c] for c in {w[1] for w in want}}


def test_bounds_never_exceed_distances_and_prune():
    draw = np.random.default_rng(5)
    centers = draw.integers(-200, 200, (12, 16))
    x = centers[draw.integers(0, 12, 3000)] + draw.integers(-9, 10, (3000, 16))
    x[:12] = centers  # distance 0, where rounding could do most harm
    pivots = cc.Pivots.of([*centers[:6].tolist(), *centers[:2].tolist()], cc.Settings(dimensions=16))
    exact = np.stack([cc.squared(x, c) for c in centers], axis=1)
    assert (pivots.bounds(pivots.distances(x), pivots.distances(centers)) <= exact).all()
    cluster, best, checked = cc.nearest(x, pivots.distances(x), centers, pivots)
    assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert checked.mean() < 4
    big = (1 << 27) * draw.choice([-1, 1], (50, 16))
    wide = cc.Pivots.of(big[:6].tolist(), cc.Settings(dimensions=16))
    assert (wide.bounds(wide.distances(big), wide.distances(big)) <= np.stack([cc.squared(big, c) for c in big], axis=1)).all()


def test_empty_idless_and_too_large(spark):
    schema = "vec_id long, embedding array<float>, cluster string"
    assert cc.cluster(spark.createDataFrame([], schema), SMALL).described().count() == 0
    assert cc.cluster(spark.createDataFrame([(None, [1.0, 2.0, 3.0], "x")], schema), SMALL).described().count() == 0
    one = cc.cluster(spark.createDataFrame([(5, [1.0, 2.0, 3.0], "x")], schema), SMALL).described()
    assert [(r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in one.collect()] == [(5, 0, 0, 0)]
    with pytest.raises(Exception, match="a component is beyond"):
        cc.cluster(spark.createDataFrame([(5, [1.0, 2.0, 3e30], "x")], schema), SMALL)


def test_no_vector_is_shuffled(spark, data_dir):
    whole = cc.whole_vectors(spark.read.parquet(f"{data_dir}/embeddings.parquet"))
    pivots = cc.Pivots.of(cc._least_hashes(whole, "a", 8), cc.Settings())
    plan = cc.assign(cc.with_pivots(whole, pivots, cc.Settings()), pivots.vectors, pivots).agg(F.sum("checked"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
