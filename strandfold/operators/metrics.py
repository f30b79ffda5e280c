"""Classification, ranking and regression metrics as aggregations.

Scores come long: ``target, truth (0/1), probability`` and, for threshold metrics, ``prediction (0/1)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.significance import correlation_p_value
from ..functions.values import is_finite
from .ordered import totals_before

OVERALL = "__OVERALL__"


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def threshold_metrics(scores: DataFrame, group: Sequence[str] = ("target",)) -> DataFrame:
    """Confusion counts in one pass, everything else is arithmetic on them; undefined ratios are 0."""
    hit, call = F.col("truth") == 1, F.col("prediction") == 1
    counts = scores.groupBy(*group).agg(
        F.count_if(hit & call).alias("tp"),
        F.count_if(~hit & call).alias("fp"),
        F.count_if(~hit & ~call).alias("tn"),
        F.count_if(hit & ~call).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return counts.select(
        *group,
        n.cast("bigint").alias("n_samples"),
        (F.col("tp") + F.col("fn")).alias("n_positive"),
        ((tp + fn) / n).alias("prevalence"),
        ((tp + tn) / n).alias("accuracy"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio_or_zero(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)).alias("mcc"),
    )


def normalised_auprc(auprc: Column, prevalence: Column) -> Column:
    """0 at the prevalence baseline, 1 for a perfect ranking; missing where that scale does not exist."""
    return F.when(
        is_finite(auprc) & is_finite(prevalence) & (prevalence < 1),
        F.try_divide(auprc - prevalence, F.lit(1.0) - prevalence),
    )


def ranking_metrics(scores: DataFrame, group: Sequence[str] = ("target",), ranges: int | None = None) -> DataFrame:
    """Average precision over distinct scores and tie-corrected ROC AUC; missing for one-class targets."""
    group = list(group)
    distinct = scores.groupBy(*group, "probability").agg(
        F.sum(F.col("truth").cast("bigint")).alias("pos"),
        F.sum((1 - F.col("truth")).cast("bigint")).alias("neg"),
    )
    walked = totals_before(distinct, group, "probability", ["pos", "neg"], descending=True, ranges=ranges)
    pos, neg = F.col("pos"), F.col("neg")
    reached = F.col("pos_before") + pos
    step_precision = pos * reached / (reached + F.col("neg_before") + neg)
    # Negatives below each score: the ones not yet passed, and half of those tied with it.
    beaten = pos * (F.col("neg_all") - F.col("neg_before") - neg + neg / F.lit(2.0))
    summed = walked.groupBy(*group).agg(
        F.max("pos_all").alias("p"),
        F.max("neg_all").alias("q"),
        F.sum(step_precision).alias("area"),
        F.sum(beaten).alias("pairs"),
    )
    two_classes = (F.col("p") > 0) & (F.col("q") > 0)
    rated = summed.select(
        *group,
        (F.col("p") + F.col("q")).alias("n_samples"),
        F.col("p").alias("n_positive"),
        (F.col("p") / (F.col("p") + F.col("q"))).alias("prevalence"),
        F.when(two_classes, F.try_divide(F.col("area"), F.col("p"))).alias("auprc"),
        F.when(two_classes, F.try_divide(F.col("pairs"), F.col("p").cast("double") * F.col("q"))).alias("roc_auc"),
    )
    return rated.select(
        *group, "n_samples", "n_positive", "prevalence", "auprc",
        normalised_auprc(F.col("auprc"), F.col("prevalence")).alias("normalized_auprc"), "roc_auc",
    )


def evaluate(scores: DataFrame) -> DataFrame:
    """The full metric table, one row per target."""
    ranked = ranking_metrics(scores).select("target", "auprc", "normalized_auprc", "roc_auc")
    return (
        threshold_metrics(scores)
        .join(ranked, "target")
        .select(
            "target", "n_samples", "n_positive", "prevalence", "auprc", "normalized_auprc", "roc_auc",
            "accuracy", "precision", "recall", "f1", "mcc",
        )
    )


def external_scores(probabilities: DataFrame, labels: DataFrame) -> DataFrame:
    """Ranking metrics over the (sample, target) pairs that both tables cover."""
    pairs = probabilities.select("sample_id", "target", "probability").join(
        labels.select("sample_id", "target", F.col("label").alias("truth")), ["sample_id", "target"]
    )
    return ranking_metrics(pairs)


def regression_summary(pairs: DataFrame, group: str | None = "cancer", min_n: int = 3, p_values: bool = True, overall: bool = True) -> DataFrame:
    """n, MAE, RMSE, Spearman and Pearson, for all pairs together and for each group.

    ``pairs``: truth, pred and the group column. Rows where either side is not finite do not count, but a
    group of only such rows still appears, with n = 0. A missing group counts in the overall row only.
    """
    tags = []
    if overall:
        tags.append(F.lit(OVERALL))
    if group:
        tags.append(F.col(group).cast("string"))
    tagged = pairs.select(F.explode(F.array(*tags)).alias("_g"), "truth", "pred").filter(F.col("_g").isNotNull())
    finite = is_finite(F.col("truth")) & is_finite(F.col("pred"))
    everyone = tagged.groupBy("_g").agg(F.count_if(finite).alias("_finite"))
    counted = tagged.filter(finite).groupBy("_g", "truth", "pred").agg(F.count(F.lit(1)).alias("w"))

    ranked = counted
    for side in ("truth", "pred"):
        weights = counted.groupBy("_g", side).agg(F.sum("w").alias("n"))
        ranks = totals_before(weights, ["_g"], side, ["n"]).select(
            "_g", side, (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias(f"{side}_rank")
        )
        ranked = ranked.join(ranks, ["_g", side])

    w = F.col("w").cast("double")

    def moments(x: str, y: str, name: str) -> list[Column]:
        a, b = F.col(x), F.col(y)
        return [
            F.sum(w * a * a).alias(f"{name}_xx"), F.sum(w * b * b).alias(f"{name}_yy"), F.sum(w * a * b).alias(f"{name}_xy"),
        ]

    means = counted.groupBy("_g").agg(
        (F.sum(w * F.col("truth")) / F.sum(w)).alias("_mt"), (F.sum(w * F.col("pred")) / F.sum(w)).alias("_mp"),
        (F.min("truth") < F.max("truth")).alias("_vt"), (F.min("pred") < F.max("pred")).alias("_vp"),
        F.sum("w").alias("_n"),
    )
    # Centred before squaring, so large offsets cost no precision.
    centred = ranked.join(means, "_g").select(
        "_g", "w", "truth", "pred",
        (F.col("truth") - F.col("_mt")).alias("ct"), (F.col("pred") - F.col("_mp")).alias("cp"),
        (F.col("truth_rank") - (F.col("_n") + 1) / 2.0).alias("rt"), (F.col("pred_rank") - (F.col("_n") + 1) / 2.0).alias("rp"),
        (F.col("_vt") & F.col("_vp")).alias("_varies"),
    )
    error = F.col("truth") - F.col("pred")
    sums = centred.groupBy("_g").agg(
        F.sum("w").alias("n"),
        (F.sum(w * F.abs(error)) / F.sum(w)).alias("mae"),
        F.sqrt(F.sum(w * error * error) / F.sum(w)).alias("rmse"),
        F.bool_and("_varies").alias("_varies"),
        *moments("ct", "cp", "p"),
        *moments("rt", "rp", "s"),
    )

    def correlation(name: str) -> Column:
        r = F.try_divide(F.col(f"{name}_xy"), F.sqrt(F.col(f"{name}_xx")) * F.sqrt(F.col(f"{name}_yy")))
        return F.when((F.col("n") >= min_n) & F.col("_varies"), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))

    table = everyone.join(
        sums.select("_g", "n", "mae", "rmse", correlation("s").alias("spearman"), correlation("p").alias("pearson")), "_g", "left"
    ).withColumn("n", F.coalesce("n", "_finite"))
    name = group or "cancer"
    columns = [F.col("_g").alias(name), "n", "mae", "rmse", "spearman"]
    if p_values:
        columns += [correlation_p_value("spearman", "n").alias("spearman_p"), "pearson", correlation_p_value("pearson", "n").alias("pearson_p")]
    else:
        columns += ["pearson"]
    return table.select(*columns)
