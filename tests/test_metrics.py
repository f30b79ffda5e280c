import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandfold.operators.align import align_features, feature_overlap, feature_stats, long_rows, standardise
from strandfold.operators.attribution import attribution_summary, top_attributions
from strandfold.operators.metrics import OVERALL, evaluate, external_scores, normalised_auprc, ranking_metrics, regression_summary


def scores(spark, groups):
    rows = [(t, y, float(p), int(p >= 0.5)) for t, pairs in groups.items() for y, p in pairs]
    return spark.createDataFrame(rows, "target string, truth int, probability double, prediction int")


def brute_ap(pairs):
    n_pos, area, seen_pos, seen = sum(y for y, _ in pairs), 0.0, 0, 0
    for cut in sorted({p for _, p in pairs}, reverse=True):
        at = [y for y, p in pairs if p == cut]
        seen_pos, seen = seen_pos + sum(at), seen + len(at)
        area += sum(at) / n_pos * seen_pos / seen
    return area


def brute_auc(pairs):
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_normalised_auprc(spark):
    df = spark.createDataFrame([(0.2, 0.2), (1.0, 0.2), (1.0, 1.0), (None, 0.5)], "a double, p double")
    got = [r["n"] for r in df.select(normalised_auprc(F.col("a"), F.col("p")).alias("n")).collect()]
    assert got == [pytest.approx(0.0), pytest.approx(1.0), None, None]


def test_ranking_against_brute_force(spark):
    rng = random.Random(3)
    groups = {
        "ties": [(rng.random() < 0.4, round(rng.random(), 1)) for _ in range(200)],
        "fine": [(rng.random() < 0.1, rng.random()) for _ in range(150)],
        "flat": [(i < 3, 0.5) for i in range(9)],
    }
    groups = {t: [(int(y), p) for y, p in pairs] for t, pairs in groups.items()}
    table = {r["target"]: r for r in ranking_metrics(scores(spark, groups)).collect()}
    for target, pairs in groups.items():
        assert table[target]["auprc"] == pytest.approx(brute_ap(pairs), abs=1e-12)
        assert table[target]["roc_auc"] == pytest.approx(brute_auc(pairs), abs=1e-12)
        assert table[target]["n_samples"] == len(pairs)
    assert table["flat"]["roc_auc"] == 0.5 and table["flat"]["normalized_auprc"] == pytest.approx(0.0)


def test_one_class_targets_and_zero_divisions(spark):
    table = {r["target"]: r for r in evaluate(scores(spark, {"none": [(0, 0.1), (0, 0.2)], "all": [(1, 0.9), (1, 0.8)]})).collect()}
    for target in ("none", "all"):
        assert table[target]["auprc"] is None and table[target]["roc_auc"] is None and table[target]["mcc"] == 0.0
    assert table["none"]["precision"] == 0.0 and table["none"]["recall"] == 0.0 and table["none"]["accuracy"] == 1.0
    assert table["all"]["f1"] == 1.0


def test_threshold_metrics_against_formulas(spark):
    pairs = [(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.2), (0, 0.1), (1, 0.5)]
    row = evaluate(scores(spark, {"t": pairs})).first()
    tp, fp, tn, fn = 2, 1, 2, 1
    assert row["accuracy"] == pytest.approx(4 / 6) and row["precision"] == pytest.approx(2 / 3) and row["recall"] == pytest.approx(2 / 3)
    assert row["mcc"] == pytest.approx((tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def test_external_scores_use_the_overlap(spark):
    probabilities = spark.createDataFrame(
        [("a", "T", 0.9), ("b", "T", 0.1), ("c", "T", 0.5), ("a", "U", 0.5)], "sample_id string, target string, probability double"
    )
    labels = spark.createDataFrame([("a", "T", 1), ("b", "T", 0), ("z", "T", 1)], "sample_id string, target string, label int")
    row = external_scores(probabilities, labels).collect()
    assert len(row) == 1 and row[0]["n_samples"] == 2 and row[0]["auprc"] == 1.0


def ranks(values):
    values = np.asarray(values)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


def test_regression_summary_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(c, float(np.round(x, 1)), float(np.round(0.5 * x + rng.normal(), 1))) for c in "AB" for x in rng.normal(size=60)]
    rows += [("C", 1.0, 2.0), ("C", 2.0, 1.0), ("D", 1.0, 3.0), ("D", 1.0, 4.0), ("D", 1.0, 5.0), (None, 0.3, 0.4)]
    rows += [("A", float("nan"), 1.0), ("B", None, 1.0), ("E", float("inf"), 1.0)]
    table = {r["cancer"]: r for r in regression_summary(spark.createDataFrame(rows, "cancer string, truth double, pred double")).collect()}
    assert set(table) == {OVERALL, "A", "B", "C", "D", "E"}

    def check(row, part):
        t, p = np.array([r[1] for r in part]), np.array([r[2] for r in part])
        assert row["n"] == len(part)
        assert row["mae"] == pytest.approx(np.abs(t - p).mean()) and row["rmse"] == pytest.approx(np.sqrt(((t - p) ** 2).mean()))
        assert row["pearson"] == pytest.approx(np.corrcoef(t, p)[0, 1])
        assert row["spearman"] == pytest.approx(np.corrcoef(ranks(t), ranks(p))[0, 1])
        assert 0 <= row["pearson_p"] <= 1 and 0 <= row["spearman_p"] <= 1

    usable = [r for r in rows if all(v is not None and math.isfinite(v) for v in r[1:])]
    check(table[OVERALL], usable)
    for cancer in "AB":
        check(table[cancer], [r for r in usable if r[0] == cancer])
    for cancer in "CD":
        assert table[cancer]["spearman"] is None and table[cancer]["pearson"] is None and table[cancer]["mae"] > 0
    assert table["E"]["n"] == 0 and table["E"]["mae"] is None


def test_regression_summary_is_the_same_for_any_partitioning(spark):
    df = spark.range(300).selectExpr("cast(id % 2 as string) cancer", "cast(id * id % 17 as double) truth", "cast(id % 29 as double) pred")
    tables = [sorted(map(tuple, regression_summary(df.repartition(n), p_values=False).collect())) for n in (1, 8)]
    for one, two in zip(*tables):
        assert one[:2] == two[:2] and one[2:] == pytest.approx(two[2:], abs=1e-12)


def cells(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, gene string, value double")


def test_feature_stats_and_standardise(spark):
    df = cells(spark, [("a", "A", 1.0), ("b", "A", 3.0), ("c", "A", None), ("a", "K", 5.0), ("b", "K", 5.0)])
    stats = {r["gene"]: (r["mean"], r["std"], r["scale"]) for r in feature_stats(df).collect()}
    assert stats == {"A": (2.0, 1.0, 1.0), "K": (5.0, 0.0, 1.0)}
    assert {(r["sample_id"], r["gene"]): r["z"] for r in standardise(df).collect()}[("a", "A")] == -1.0


def test_align_features(spark):
    df = cells(spark, [("s", "A", 4.0), ("s", "B", 8.0), ("s", "EXTRA", 1.0), ("t", "A", 2.0), ("t", "A", 6.0), ("t", "B", None)])
    ids = spark.createDataFrame([("s",), ("t",), ("u",)], "sample_id string")
    dense, overlap = align_features(df, ids, ["B", "C", "A"], np.array([2.0, 3.0, 1.0]), 0.5)
    assert overlap == pytest.approx(2 / 3)
    rows = {r["sample_id"]: list(r["features"]) for r in dense.collect()}
    assert rows == {"s": [8.0, 3.0, 4.0], "t": [2.0, 3.0, 4.0], "u": [2.0, 3.0, 1.0]}
    long = {(r["sample_id"], r["gene"]): r["value"] for r in long_rows(dense, ["B", "C", "A"]).collect()}
    assert long[("s", "C")] == 3.0 and len(long) == 9
    assert feature_overlap(df, ["A", "Z"]) == 0.5
    with pytest.raises(ValueError, match="feature overlap"):
        align_features(df, ids, ["A", "B", "C"], np.array([1.0, 2.0, 3.0]), 0.8)


def test_attribution_tables(spark):
    values = spark.createDataFrame(
        [("a", "F1", -3.0), ("b", "F1", 1.0), ("a", "F2", 0.5), ("b", "F2", 0.5), ("a", "F3", 2.0), ("b", "F3", 2.0)],
        "sample_id string, feature string, shap_value double",
    )
    summary = attribution_summary(values, "T", "m")
    assert [(r["rank"], r["feature"], r["mean_abs_shap"], r["mean_shap"]) for r in summary.orderBy("rank").collect()] == [
        (1, "F1", 2.0, -1.0), (2, "F3", 2.0, 2.0), (3, "F2", 0.5, 0.5),
    ]
    top = top_attributions(values, summary, cells(spark, [("a", "F1", 9.0)]), 1)
    assert {(r["sample_id"], r["feature"], r["shap_value"], r["expression_value"]) for r in top.collect()} == {
        ("a", "F1", -3.0, 9.0), ("b", "F1", 1.0, None),
    }
