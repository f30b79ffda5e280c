import random

import pytest
from pyspark.sql import functions as F

from strandfold.operators.dedupe import keep_first
from strandfold.operators.folds import assign_folds, plain_folds, seeded_sample, stratified_folds
from strandfold.operators.ordered import average_ranks, seeded_ordinals, totals_before


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("ranges", [2, 5, 32])
def test_totals_before_equals_a_sorted_walk(spark, descending, ranges):
    rng = random.Random(7)
    rows = [(g, float(v), rng.randint(1, 9)) for g in "ab" for v in rng.sample(range(1000), 120 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, v double, w bigint")
    got = {(r["g"], r["v"]): (r["w_before"], r["w_all"]) for r in totals_before(df, ["g"], "v", ["w"], descending, ranges).collect()}
    for g, v, w in rows:
        earlier = [x for h, u, x in rows if h == g and (u > v if descending else u < v)]
        assert got[g, v] == (sum(earlier), sum(x for h, _, x in rows if h == g))


def test_average_ranks_with_ties_and_one_hot_group(spark):
    values = [1.0] * 50 + [2.0, 3.0, 3.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = {r["v"]: (r["rank"], r["n"], r["n_all"]) for r in average_ranks(df, ["g"], "v").collect()}
    assert got == {1.0: (25.5, 50, 53), 2.0: (51.0, 1, 53), 3.0: (52.5, 2, 53)}


def test_seeded_ordinals_do_not_depend_on_partitioning(spark):
    df = spark.range(500).select(F.concat(F.lit("s"), "id").alias("sample_id"))
    results = []
    for parts in (1, 8):
        rows = seeded_ordinals(df.repartition(parts), "sample_id", 3).collect()
        results.append(sorted((r["ordinal"], r["sample_id"], r["total"]) for r in rows))
    assert results[0] == results[1]
    assert [o for o, _, _ in results[0]] == list(range(1, 501))


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, None), ("a", 3, 5.0), ("b", 9, 1.0)], "k string, pos int, v double")
    assert sorted(map(tuple, keep_first(df, ["k"], ["pos"]).collect())) == [("a", 1, None), ("b", 9, 1.0)]


def samples(spark, sizes):
    rows = [(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, cancer string")


def fold_sizes(df):
    return sorted(r["count"] for r in df.groupBy("fold").count().collect())


@pytest.mark.parametrize("n,k", [(23, 5), (5, 5), (24, 4), (7, 3)])
def test_plain_folds_are_balanced(spark, n, k):
    sizes = fold_sizes(plain_folds(samples(spark, {"A": n}), k, 1))
    assert len(sizes) == k and sum(sizes) == n and sizes[-1] - sizes[0] <= 1


def test_stratified_folds_are_balanced_in_each_cohort(spark):
    df = stratified_folds(samples(spark, {"A": 23, "B": 11, "C": 7}), 5, 1)
    sizes = fold_sizes(df)
    assert sizes[-1] - sizes[0] <= 1
    for cancer in "ABC":
        inner = fold_sizes(df.filter(F.col("cancer") == cancer))
        assert len(inner) == 5 and inner[-1] - inner[0] <= 1


def test_fold_method_follows_the_smallest_cohort(spark):
    assert assign_folds(samples(spark, {"A": 9, "B": 5}), 5)[1] == "stratified_by_cancer"
    assert assign_folds(samples(spark, {"A": 9, "B": 4}), 5)[1] == "shuffled_kfold"
    assert assign_folds(samples(spark, {"A": 9}), 5)[1] == "shuffled_kfold"
    with pytest.raises(ValueError, match="folds"):
        assign_folds(samples(spark, {"A": 4}), 5)


def test_seed_changes_folds_and_sample_is_exact(spark):
    df = samples(spark, {"A": 40})
    one, two = (sorted((r["sample_id"], r["fold"]) for r in plain_folds(df, 5, s).collect()) for s in (1, 2))
    assert one != two
    assert seeded_sample(df, 7).count() == 7
    assert seeded_sample(df, 70).count() == 40
    assert seeded_sample(df, None).count() == 40
    picks = [sorted(r["sample_id"] for r in seeded_sample(df.repartition(p), 7).collect()) for p in (1, 6)]
    assert picks[0] == picks[1]
