"""Queries over targets, alignment, folds, metrics, transfer and streams."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..models.burden import BurdenModel
from ..models.explain import explain_cohort
from ..models.multilabel import MultiLabelModel
from ..models.trees import balanced_weights, leaf_paths, make_classifier, tree_shap, with_vector
from ..operators import align as al
from ..operators import cohort as co
from ..operators import metrics as me
from ..operators import summaries as su
from ..operators import targets as ta
from ..operators.attribution import attribution_summary, top_attributions
from ..operators.folds import plain_folds, seeded_sample, stratified_folds
from ..operators.transfer import cohort_mixing, neighbour_mixing, principal_components, rank_normalise
from ..session import materialise, scratch_path
from ..streaming.burden import windowed_burden
from ..streaming.cells import gather_samples, keyed_state
from ..streaming.run import drain, drain_updates, score_stream
from .fixtures import CODING_EVENTS, Tables
from .registry import query


def _round(df, *columns: str, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ targets and weights

_PREVALENCE = """SELECT target, cast(sum(label) AS BIGINT) AS n_positive, (SELECT count(*) FROM fx_samples) AS n_samples,
    sum(label) / (SELECT count(*) FROM fx_samples) AS p FROM fx_mutations GROUP BY target"""


@query(
    "prevalence", f"SELECT target, n_positive, n_samples, round(p, 6) AS prevalence FROM ({_PREVALENCE})", ("fx_mutations", "fx_samples")
)
def prevalence(t: Tables):
    return _round(ta.prevalence(t.mutations(), t.samples()), "prevalence")


@query(
    "select_targets",
    f"SELECT target, round(p, 6) AS prevalence FROM ({_PREVALENCE}) WHERE p >= 0.05 ORDER BY p DESC, target LIMIT 3",
    ("fx_mutations", "fx_samples"),
)
def select_targets(t: Tables):
    return _round(ta.select_targets(t.mutations(), t.samples(), 0.05, 3).select("target", "prevalence"), "prevalence")


@query(
    "selected_labels",
    f"""SELECT sample_id, target, label FROM fx_mutations WHERE target IN (
        SELECT target FROM ({_PREVALENCE}) WHERE p >= 0.05 ORDER BY p DESC, target LIMIT 3)""",
    ("fx_mutations", "fx_samples"),
)
def selected_labels(t: Tables):
    return ta.keep_selected(t.mutations(), t.samples(), 0.05, 3)


@query(
    "class_weights",
    f"""SELECT target, n_positive, n_samples - n_positive AS n_negative,
        round(CASE WHEN n_positive > 0 THEN least(greatest((n_samples - n_positive) / n_positive, 1e0), 1e6) ELSE 1e0 END, 6) AS pos_weight,
        round((n_samples - n_positive) / greatest(n_positive, 1), 6) AS tree_scale,
        round(n_samples / (2e0 * greatest(n_positive, 1)), 6) AS balanced_positive,
        round(n_samples / (2e0 * greatest(n_samples - n_positive, 1)), 6) AS balanced_negative
    FROM ({_PREVALENCE})""",
    ("fx_mutations", "fx_samples"),
)
def class_weights(t: Tables):
    return _round(
        ta.class_weights(t.mutations(), t.samples()), "pos_weight", "tree_scale", "balanced_positive", "balanced_negative"
    )


# ------------------------------------------------------------------ feature statistics and alignment

_STATS = "SELECT gene, avg(value) AS mean, stddev_pop(value) AS std FROM fx_expression GROUP BY gene"


@query(
    "feature_stats",
    f"""SELECT gene, round(mean, 6) AS mean, round(std, 6) AS std, round(CASE WHEN std > 0 THEN std ELSE 1 END, 6) AS scale
    FROM ({_STATS})""",
    ("fx_expression",),
)
def feature_stats(t: Tables):
    return _round(al.feature_stats(t.expression()), "mean", "std", "scale")


@query(
    "merged_feature_stats",
    """, x AS (SELECT gene, value, cancer FROM fx_expression JOIN fx_samples USING (sample_id))
    SELECT gene, count(*) AS n, count(DISTINCT cancer) AS parts, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
        round(CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END, 6) AS scale FROM x GROUP BY gene""",
    ("fx_expression", "fx_samples"),
)
def merged_feature_stats(t: Tables):
    # A state per cohort, merged: no cohort is read for another's sake.
    states = materialise(su.gene_states(t.expression().join(t.samples(), "sample_id"), "cancer"), "gene_states")
    return _round(su.stats_from_states(states), "mean", "std", "scale")


@query(
    "merged_prevalence",
    """SELECT target, cast(sum(label) AS BIGINT) AS n_positive, (SELECT count(*) FROM fx_samples) AS n_samples,
        round(sum(label) / (SELECT count(*) FROM fx_samples), 6) AS prevalence FROM fx_mutations SEMI JOIN fx_samples USING (sample_id) GROUP BY target""",
    ("fx_mutations", "fx_samples"),
)
def merged_prevalence(t: Tables):
    positives, sizes = su.target_states(t.mutations(), t.samples(), "cancer")
    return _round(su.prevalence_from_states(materialise(positives, "target_states"), sizes), "prevalence")


@query(
    "standardise",
    f"""SELECT sample_id, gene, value, round((value - mean) / CASE WHEN std > 0 THEN std ELSE 1 END, 6) AS z
    FROM fx_expression JOIN ({_STATS}) USING (gene)""",
    ("fx_expression",),
)
def standardise(t: Tables):
    return _round(al.standardise(t.expression()), "z")


#: The first cohort by name is the reference of the others.
_REFERENCE = "(SELECT min(cancer) FROM fx_samples)"


def _reference(samples) -> str:
    return samples.agg(F.min("cancer")).head()[0]


@query(
    "align_features",
    f""", train AS (SELECT gene, avg(value) AS mean FROM fx_expression JOIN fx_samples USING (sample_id)
        WHERE cancer = {_REFERENCE} GROUP BY gene UNION ALL SELECT 'ABSENT', 7.5e0)
    SELECT s.sample_id, f.gene, round(coalesce(x.value, f.mean), 6) AS value
    FROM (SELECT sample_id FROM fx_samples WHERE cancer <> {_REFERENCE}) s CROSS JOIN train f
    LEFT JOIN fx_expression x ON x.sample_id = s.sample_id AND x.gene = f.gene""",
    ("fx_expression", "fx_samples"),
)
def align_features(t: Tables):
    # Read for the means, the overlap check and the rows.
    expression, samples = materialise(t.expression(), "expression"), t.samples()
    first = _reference(samples)
    training = expression.join(samples.filter(F.col("cancer") == first), "sample_id", "left_semi")
    means = {r["gene"]: r["mean"] for r in al.feature_stats(training).collect()}
    means["ABSENT"] = 7.5
    features = sorted(means)
    scored = samples.filter(F.col("cancer") != first).select("sample_id")
    dense, _ = al.align_features(
        expression.join(scored, "sample_id", "left_semi"), scored, features, [means[g] for g in features]
    )
    return _round(al.long_rows(dense, features), "value")


# ------------------------------------------------------------------ metrics

_CONFUSION = """SELECT target, cast(sum(truth * pred) AS DOUBLE) AS tp, cast(sum((1 - truth) * pred) AS DOUBLE) AS fp,
    cast(sum((1 - truth) * (1 - pred)) AS DOUBLE) AS tn, cast(sum(truth * (1 - pred)) AS DOUBLE) AS fn
    FROM (SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS pred FROM fx_scores) GROUP BY target"""
_THRESHOLD = f"""SELECT target, cast(tp + fp + tn + fn AS BIGINT) AS n_samples, cast(tp + fn AS BIGINT) AS n_positive,
    (tp + fn) / (tp + fp + tn + fn) AS prevalence, (tp + tn) / (tp + fp + tn + fn) AS accuracy,
    coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
    coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM ({_CONFUSION})"""
_RATIOS = ("prevalence", "accuracy", "precision", "recall", "f1", "mcc")


def _rank_sql(source: str) -> str:
    return f"""SELECT target, cast(max(p + q) AS BIGINT) AS n_samples, cast(max(p) AS BIGINT) AS n_positive, max(p) / max(p + q) AS prevalence,
        CASE WHEN max(p) > 0 AND max(q) > 0 THEN sum(pos * cp / (cp + cn)) / max(p) END AS auprc,
        CASE WHEN max(p) > 0 AND max(q) > 0 THEN sum(pos * (q - cn + neg / 2e0)) / (max(p) * max(q)) END AS roc_auc
    FROM (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY target) AS p,
            sum(neg) OVER (PARTITION BY target) AS q
        FROM (SELECT target, probability, cast(sum(truth) AS DOUBLE) AS pos, cast(sum(1 - truth) AS DOUBLE) AS neg FROM {source} GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY target ORDER BY probability DESC)) GROUP BY target"""


def _scores(t: Tables):
    return t.scores().withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


def _rounded_sql(columns: tuple[str, ...]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query("threshold_metrics", f"SELECT target, n_samples, n_positive, {_rounded_sql(_RATIOS)} FROM ({_THRESHOLD})", ("fx_scores",))
def threshold_metrics(t: Tables):
    return _round(me.threshold_metrics(_scores(t)), *_RATIOS)


_RANKED = "round(auprc, 6) AS auprc, round((auprc - prevalence) / nullif(1 - prevalence, 0), 6) AS normalized_auprc, round(roc_auc, 6) AS roc_auc"


@query(
    "ranking_metrics",
    f"SELECT target, n_samples, n_positive, round(prevalence, 6) AS prevalence, {_RANKED} FROM ({_rank_sql('fx_scores')})",
    ("fx_scores",),
)
def ranking_metrics(t: Tables):
    return _round(me.ranking_metrics(t.scores()), "prevalence", "auprc", "normalized_auprc", "roc_auc")


@query(
    "metric_table",
    f"""SELECT target, a.n_samples, a.n_positive, round(a.prevalence, 6) AS prevalence, round(auprc, 6) AS auprc,
        round((auprc - a.prevalence) / nullif(1 - a.prevalence, 0), 6) AS normalized_auprc, round(roc_auc, 6) AS roc_auc,
        {_rounded_sql(_RATIOS[1:])}
    FROM ({_THRESHOLD}) a JOIN ({_rank_sql('fx_scores')}) b USING (target)""",
    ("fx_scores",),
)
def metric_table(t: Tables):
    return _round(me.evaluate(_scores(t)), "auprc", "normalized_auprc", "roc_auc", *_RATIOS)


@query(
    "document_label_metrics",
    f""", fx_flags AS (SELECT l.doc_id, t.target, CASE WHEN t.target = 'quality' THEN quality ELSE toxic END AS truth,
            round(n_chars / 1000e0, 3) AS probability
        FROM labels l JOIN documents d USING (doc_id), (VALUES ('quality'), ('toxic')) AS t(target))
    SELECT target, n_samples, n_positive, round(prevalence, 6) AS prevalence, {_RANKED} FROM ({_rank_sql('fx_flags')})""",
)
def document_label_metrics(t: Tables):
    flags = t.table("labels").unpivot(["doc_id"], ["quality", "toxic"], "target", "truth")
    rows = flags.join(t.table("documents").select("doc_id", "n_chars"), "doc_id")
    return _round(
        me.ranking_metrics(rows.withColumn("probability", F.round(F.col("n_chars") / 1000.0, 3))),
        "prevalence", "auprc", "normalized_auprc", "roc_auc",
    )


@query(
    "external_scores",
    f""", known AS (SELECT target, 'L' || (row_number() OVER (ORDER BY target) - 1) AS l FROM (SELECT DISTINCT target FROM fx_mutations)),
    pairs AS (SELECT k.target, m.label AS truth, s.probability
        FROM fx_scores s JOIN known k ON k.l = s.target JOIN fx_mutations m ON m.sample_id = 'S' || s.vec_id AND m.target = k.target)
    SELECT target, n_samples, n_positive, round(prevalence, 6) AS prevalence, {_RANKED} FROM ({_rank_sql('pairs')})""",
    ("fx_scores", "fx_mutations"),
)
def external_scores(t: Tables):
    # The scores name their targets by number, in the order of the labels' names.
    names = t.mutations().select("target").distinct().select("target", (F.row_number().over(W.orderBy("target")) - 1).alias("number"))
    numbered = names.select(F.concat(F.lit("L"), F.col("number").cast("string")).alias("l"), "target")
    scores = t.scores().withColumnRenamed("target", "l").join(numbered, "l").select(
        F.concat(F.lit("S"), F.col("vec_id").cast("string")).alias("sample_id"), "target", "probability"
    )
    return _round(me.external_scores(scores, t.mutations()), "prevalence", "auprc", "normalized_auprc", "roc_auc")


@query(
    "top_metrics",
    f"SELECT target, round(auprc, 6) AS auprc FROM ({_rank_sql('fx_scores')}) ORDER BY round(auprc, 6) DESC, target LIMIT 4",
    ("fx_scores",),
)
def top_metrics(t: Tables):
    return ta.top_rows(_round(me.ranking_metrics(t.scores()).select("target", "auprc"), "auprc"), "auprc", "target", 4)


@query(
    "tagged_union",
    f"""SELECT 'all' AS input, target, round(auprc, 6) AS auprc FROM ({_rank_sql('fx_scores')})
    UNION ALL SELECT 'rounded', target, round(auprc, 6) FROM
        ({_rank_sql('(SELECT target, truth, round(probability, 1) AS probability FROM fx_scores)')})""",
    ("fx_scores",),
)
def tagged_union(t: Tables):
    coarse = t.scores().withColumn("probability", F.round("probability", 1))
    tables = {"all": t.scores(), "rounded": coarse}
    return _round(
        co.tagged_union({k: me.ranking_metrics(v).select("target", "auprc") for k, v in tables.items()}), "auprc"
    )


_SUMMARY_SQL = """, g AS (SELECT '__OVERALL__' AS cancer, truth, pred FROM fx_regression
        UNION ALL SELECT cancer, truth, pred FROM fx_regression),
    r AS (SELECT *, rank() OVER (PARTITION BY cancer ORDER BY truth) + (count(*) OVER (PARTITION BY cancer, truth) - 1) / 2e0 AS rt,
        rank() OVER (PARTITION BY cancer ORDER BY pred) + (count(*) OVER (PARTITION BY cancer, pred) - 1) / 2e0 AS rp FROM g)
    SELECT cancer, count(*) AS n, round(avg(abs(truth - pred)), 6) AS mae, round(sqrt(avg((truth - pred) * (truth - pred))), 6) AS rmse,
        round(corr(rt, rp), 6) AS spearman, round(corr(truth, pred), 6) AS pearson FROM r GROUP BY cancer"""


@query("tmb_summary", _SUMMARY_SQL, ("fx_regression",))
def tmb_summary(t: Tables):
    return _round(me.regression_summary(t.regression(), p_values=False), "mae", "rmse", "spearman", "pearson")


#: Student's t has a finite series for whole degrees of freedom; a correlation is the sine of its angle.
_P_SQL = _SUMMARY_SQL.replace(" FROM g)\n    SELECT cancer,", " FROM g),\n    base AS (SELECT cancer,").replace("round(corr(rt, rp), 6)", "corr(rt, rp)").replace("round(corr(truth, pred), 6)", "corr(truth, pred)") + """),
    s AS (SELECT cancer, kind, least(abs(r), 1) AS r, n - 2 AS v FROM (SELECT cancer, n, 's' AS kind, spearman AS r FROM base
        UNION ALL SELECT cancer, n, 'p', pearson FROM base) WHERE n >= 3 AND isfinite(r)),
    f AS (SELECT cancer, kind, pow(1 - r * r, i) * exp(sum(CASE WHEN i = 0 THEN 0 WHEN v % 2 = 0 THEN ln((2 * i - 1) / (2e0 * i))
            ELSE ln(2e0 * i / (2 * i + 1)) END) OVER (PARTITION BY cancer, kind ORDER BY i)) AS term
        FROM (SELECT *, unnest(range(0, CASE WHEN v % 2 = 0 THEN v // 2 ELSE (v - 1) // 2 END)) AS i FROM s)),
    sums AS (SELECT cancer, kind, sum(term) AS a FROM f GROUP BY cancer, kind),
    p AS (SELECT cancer, kind, CASE WHEN v % 2 = 0 THEN 1 - r * a ELSE 1 - 2 / pi() * (asin(r) + r * sqrt(1 - r * r) * coalesce(a, 0)) END AS p
        FROM s LEFT JOIN sums USING (cancer, kind))
    SELECT b.cancer, n, mae, rmse, round(spearman, 6) AS spearman, round(x.p, 9) AS spearman_p, round(pearson, 6) AS pearson, round(y.p, 9) AS pearson_p
    FROM base b LEFT JOIN p x ON x.cancer = b.cancer AND x.kind = 's' LEFT JOIN p y ON y.cancer = b.cancer AND y.kind = 'p'"""


@query("tmb_summary_pvalues", _P_SQL, ("fx_regression",))
def tmb_summary_pvalues(t: Tables):
    found = _round(me.regression_summary(t.regression()), "mae", "rmse", "spearman", "pearson")
    return _round(found, "spearman_p", "pearson_p", digits=9)


# ------------------------------------------------------------------ folds and samples


@query(
    "folds_plain",
    "SELECT sample_id, cancer, ntile(5) OVER (ORDER BY md5(sample_id || ':42'), sample_id) AS fold FROM fx_samples",
    ("fx_samples",),
)
def folds_plain(t: Tables):
    return plain_folds(t.samples(), 5, 42)


@query(
    "folds_stratified",
    """SELECT sample_id, cancer, (row_number() OVER (ORDER BY cancer, md5(sample_id || ':42'), sample_id) - 1) % 5 + 1 AS fold
    FROM fx_samples""",
    ("fx_samples",),
)
def folds_stratified(t: Tables):
    return stratified_folds(t.samples(), 5, 42)


@query(
    "seeded_sample",
    "SELECT sample_id, cancer FROM fx_samples ORDER BY md5(sample_id || ':42'), sample_id LIMIT 500",
    ("fx_samples",),
)
def seeded_sample_query(t: Tables):
    return seeded_sample(t.samples(), 500, 42)


# ------------------------------------------------------------------ transfer


@query(
    "rank_normalise",
    f""", x AS (SELECT * FROM fx_expression JOIN fx_samples USING (sample_id)),
    e AS (SELECT sample_id, cancer, gene, (rank() OVER (PARTITION BY cancer, gene ORDER BY value)
            + (count(*) OVER (PARTITION BY cancer, gene, value) - 1) / 2e0 - 0.5e0) / count(*) OVER (PARTITION BY cancer, gene) AS q
        FROM x WHERE cancer <> {_REFERENCE}),
    t AS (SELECT gene, value, row_number() OVER (PARTITION BY gene ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY gene) AS m
        FROM x WHERE cancer = {_REFERENCE}),
    p AS (SELECT sample_id, cancer, e.gene, q * (m - 1) AS pos, m FROM e JOIN (SELECT DISTINCT gene, m FROM t) USING (gene))
    SELECT p.cancer, p.sample_id, p.gene, round(a.value * (1 - (pos - floor(pos))) + b.value * (pos - floor(pos)) + 1e-8, 5) AS value
    FROM p JOIN t a ON a.gene = p.gene AND a.i = floor(pos) JOIN t b ON b.gene = p.gene AND b.i = least(floor(pos) + 1, p.m - 1)""",
    ("fx_expression", "fx_samples"),
)
def rank_normalise_query(t: Tables):
    # Read many times below, as a prepared cohort would be.
    tagged = materialise(t.expression().join(t.samples(), "sample_id"), "expression")
    cohorts = sorted(r["cancer"] for r in tagged.select("cancer").distinct().collect())
    first = _reference(t.samples())
    reference = tagged.filter(F.col("cancer") == first)
    mapped = [rank_normalise(tagged.filter(F.col("cancer") == c), reference).withColumn("cancer", F.lit(c)) for c in cohorts if c != first]
    # Means of two values of six digits lie on the edge of rounding to five; both sides move off it.
    return _round(reduce(DataFrame.unionByName, mapped).withColumn("value", F.col("value") + 1e-8), "value", digits=5)


def _points(t: Tables):
    return t.table("embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") % 3).alias("label"), F.col("embedding").cast("array<double>").alias("features")
    )


@query(
    "neighbour_mixing",
    """, e AS (SELECT vec_id AS id, label % 3 AS label, embedding::DOUBLE[] AS v FROM embeddings),
    d AS (SELECT a.id, a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.id ORDER BY
            round(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(a.v, b.v)]), 9), b.id) AS r
        FROM e a JOIN e b ON a.id <> b.id),
    s AS (SELECT id, avg(CASE WHEN la <> lb THEN 1e0 ELSE 0e0 END) AS m FROM d WHERE r <= 30 GROUP BY id),
    p AS (SELECT avg(CASE WHEN label = 0 THEN 1e0 ELSE 0e0 END) AS p FROM e)
    SELECT round(avg(m), 6) AS mixing, count(*) AS n_points, round(2 * max(p) * (1 - max(p)), 6) AS balanced FROM s, p""",
)
def neighbour_mixing_query(t: Tables):
    return _round(neighbour_mixing(_points(t), 30), "mixing", "balanced")


@query(
    "neighbour_mixing_pca",
    # All components of standardised points: a rotation, which keeps every distance.
    """, flat AS (SELECT vec_id AS id, label % 3 AS label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    stats AS (SELECT i, avg(x) AS m, stddev_samp(x) AS sd FROM flat GROUP BY i),
    e AS (SELECT id, label, list((x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END ORDER BY i) AS v FROM flat JOIN stats USING (i) GROUP BY id, label),
    d AS (SELECT a.id, a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.id ORDER BY
            round(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(a.v, b.v)]), 6), b.id) AS r
        FROM e a JOIN e b ON a.id <> b.id),
    s AS (SELECT id, avg(CASE WHEN la <> lb THEN 1e0 ELSE 0e0 END) AS m FROM d WHERE r <= 30 GROUP BY id)
    SELECT round(avg(m), 6) AS mixing, count(*) AS n_points FROM s""",
)
def neighbour_mixing_pca(t: Tables):
    points = _points(t)
    width = points.select(F.max(F.size("features"))).head()[0]
    mixed = neighbour_mixing(principal_components(points, width), 30, digits=6)
    return _round(mixed.select("mixing", "n_points"), "mixing")


@query("cohort_mixing")
def cohort_mixing_query(t: Tables):
    # All cohorts and genes, 20 components, 30 neighbours: components have no SQL; tests compare with brute force.
    tagged = materialise(t.expression().join(t.samples(), "sample_id"), "expression")
    cohorts = sorted(r["cancer"] for r in tagged.select("cancer").distinct().collect())
    parts = {c: tagged.filter(F.col("cancer") == c).select("sample_id", "gene", "value") for c in cohorts}
    return cohort_mixing(parts)


@query("neighbour_mixing_pca_values")
def neighbour_mixing_pca_values(t: Tables):
    return neighbour_mixing(principal_components(_points(t), 20), 30)


# ------------------------------------------------------------------ attribution summaries

_SHAP = """, s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    f AS (SELECT i, avg(abs(v)) AS a, avg(v) AS m FROM s GROUP BY i),
    r AS (SELECT 'F' || lpad(i::VARCHAR, 3, '0') AS feature, i, a, m FROM f)"""


def _shap_values(t: Tables):
    return t.vectors().select("sample_id", F.posexplode("features").alias("i", "shap_value")).select(
        "sample_id", F.format_string("F%03d", "i").alias("feature"), "shap_value"
    )


@query(
    "shap_summary_sql",
    _SHAP + """ SELECT 'T' AS target, 'given' AS method, row_number() OVER (ORDER BY a DESC, feature) AS rank, feature,
        round(a, 6) AS mean_abs_shap, round(m, 6) AS mean_shap FROM r""",
)
def shap_summary(t: Tables):
    return _round(attribution_summary(_shap_values(t), "T", "given"), "mean_abs_shap", "mean_shap")


@query(
    "shap_top_sql",
    _SHAP + """, b AS (SELECT i, feature FROM r ORDER BY a DESC, feature LIMIT 20)
    SELECT 'V' || vec_id AS sample_id, 'T' AS target, 'given' AS method, feature, round(v, 6) AS shap_value,
        round(v * 2, 6) AS expression_value FROM s JOIN b USING (i)""",
)
def shap_top(t: Tables):
    values = _shap_values(t)
    expression = values.select("sample_id", F.col("feature").alias("gene"), (F.col("shap_value") * 2).alias("value"))
    top = top_attributions(values, attribution_summary(values, "T", "given"), expression, 20)
    return _round(top, "shap_value", "expression_value")


# ------------------------------------------------------------------ streams


@query(
    "stream_tmb",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, sample_id, count(*) AS tmb FROM fx_events
    WHERE effect IN ('click', 'error', 'purchase') GROUP BY 1, 2""",
    ("fx_events",),
)
def stream_tmb(t: Tables):
    schema = t.table("events").schema
    raw = t.spark.readStream.schema(schema).parquet(f"{t.directory}/events.parque[t]")
    # The file's time has no zone and means UTC.
    instant = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts))")
    events = raw.select(
        "event_id", instant.alias("ts"), t.sample("user_id").alias("raw_sample"), F.col("event_type").alias("variant_class")
    )
    counted = drain_updates(windowed_burden(events, CODING_EVENTS), "stream_tmb", ["window_start", "sample_id"], "tmb")
    day = F.expr("cast(date_add(DATE '1970-01-01', cast(unix_seconds(window_start) div 86400 AS int)) AS string)")
    return counted.select(day.alias("day"), "sample_id", "tmb")


# ------------------------------------------------------------------ models
#
# What a trained model says has no SQL form, but much about it has: which rows come out, folds and labels, that a stored
# or streamed model scores like the one in memory, that attributions add up. These are compared with SQL; the numbers
# themselves come from the queries named ..._values.

_SMALL_TREES = {"n_estimators": 10, "max_depth": 3}
_SMALL_NETWORK = {"hidden_layers": [32, 16], "epochs": 3, "batch_size": 32, "learning_rate": 0.005, "folds": 3}

_VECTORS = """, v AS (SELECT 'V' || vec_id AS sample_id, 'C' || label % 3 AS cancer, label, embedding::DOUBLE[] AS x FROM embeddings),
    b AS (SELECT *, greatest(round(40 * (1 + 2 * x[1] + x[2])), 0) AS tmb,
        (row_number() OVER (ORDER BY cancer, md5(sample_id || ':42'), sample_id) - 1) % 3 + 1 AS fold FROM v),
    g AS (SELECT DISTINCT 'T' || label AS target FROM v),
    h AS (SELECT 'G' || lpad(i::VARCHAR, 3, '0') AS feature FROM (SELECT unnest(range((SELECT max(len(x)) FROM v))) AS i))"""
_CLOSE = 1e-6


def _finite(name: str):
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf"))


def _all_finite(array: str):
    return F.forall(array, lambda x: x.isNotNull() & ~F.isnan(x))


@query("burden_cv_values")
def burden_cv_values(t: Tables):
    return BurdenModel("gradient_boosting", folds=3, **_SMALL_TREES).cross_validate(t.vector_cohort()).predictions


@query("burden_cv", _VECTORS + " SELECT sample_id, cancer, fold, round(log2(tmb + 1), 6) AS tmb_log2_true, true AS finite FROM b")
def burden_cv(t: Tables):
    finite = _finite("tmb_log2_pred") & _finite("tmb_pred") & (F.col("tmb_pred") >= 0)
    return burden_cv_values(t).select("sample_id", "cancer", "fold", F.round("tmb_log2_true", 6).alias("tmb_log2_true"), finite.alias("finite"))


@query("burden_cv_summary_values")
def burden_cv_summary_values(t: Tables):
    return BurdenModel("random_forest", folds=3, n_estimators=10, max_depth=5).cross_validate(t.vector_cohort()).summary


@query(
    "burden_cv_summary",
    _VECTORS + """ SELECT cancer, count(*) AS n, true AS consistent FROM b GROUP BY cancer
    UNION ALL SELECT '__OVERALL__', count(*), true FROM b""",
)
def burden_cv_summary(t: Tables):
    within = (F.col("mae") <= F.col("rmse")) & (F.col("mae") >= 0) & (F.abs("pearson") <= 1) & (F.abs("spearman") <= 1) & F.col("pearson_p").between(0, 1)
    return burden_cv_summary_values(t).select("cancer", "n", within.alias("consistent"))


@query("burden_predict_values")
def burden_predict_values(t: Tables):
    data = t.vector_cohort()
    return BurdenModel("random_forest", n_estimators=10, max_depth=5).fit(data).predict(data)


@query("burden_predict", _VECTORS + " SELECT sample_id, true AS consistent FROM v")
def burden_predict(t: Tables):
    back = F.greatest(F.pow(F.lit(2.0), F.col("tmb_log2_pred")) - 1, F.lit(0.0))
    return burden_predict_values(t).select("sample_id", (F.abs(back - F.col("tmb_pred")) < _CLOSE).alias("consistent"))


def _trained(t: Tables) -> MultiLabelModel:
    return MultiLabelModel(**_SMALL_NETWORK).fit(t.vector_cohort())


@query("tree_shap_summary_values")
def tree_shap_summary_values(t: Tables):
    return explain_cohort(t.vector_cohort(), "T0", "gradient_boosting", params=_SMALL_TREES).summary


def _adds_up(t: Tables, kind: str, params: dict):
    """Per sample, whether output less attributions is the same base value as for all."""
    rows = t.vectors().select("sample_id", "features", (F.col("label") == 0).cast("int").alias("label"))
    rows = materialise(with_vector(balanced_weights(rows)), "labelled")
    model = make_classifier(kind, {"random_state": 42, **params}).fit(rows)
    given = "rawPrediction" if kind == "gradient_boosting" else "probability"
    output = model.transform(rows).select("sample_id", vector_to_array(given)[1].alias("output"))
    total = F.aggregate("shap", F.lit(0.0), lambda a, x: a + x)
    base = materialise(tree_shap(rows, leaf_paths(t.spark, model)).join(output, "sample_id").select("sample_id", (F.col("output") - total).alias("base")), "bases")
    edges = base.agg(F.min("base").alias("low"), F.max("base").alias("high")).head()
    return base.select("sample_id", (F.lit(edges["high"] - edges["low"]) < _CLOSE).alias("adds_up"))


@query("tree_shap_summary", _VECTORS + " SELECT sample_id, true AS adds_up FROM v")
def tree_shap_summary(t: Tables):
    return _adds_up(t, "gradient_boosting", _SMALL_TREES)


@query("tree_shap_forest", _VECTORS + " SELECT sample_id, true AS adds_up FROM v")
def tree_shap_forest(t: Tables):
    return _adds_up(t, "random_forest", {"n_estimators": 10, "max_depth": 4})


@query("tree_shap_top_values")
def tree_shap_top_values(t: Tables):
    return explain_cohort(t.vector_cohort(), "T0", "random_forest", params={"n_estimators": 10, "max_depth": 4}).sample_values


@query("tree_shap_top", _VECTORS + " SELECT sample_id, least(20, (SELECT count(*) FROM h)) AS n_features, true AS finite FROM v")
def tree_shap_top(t: Tables):
    values = tree_shap_top_values(t)
    return values.groupBy("sample_id").agg(F.countDistinct("feature").alias("n_features"), F.bool_and(_finite("shap_value")).alias("finite"))


@query("network_cv_values")
def network_cv_values(t: Tables):
    return MultiLabelModel(**_SMALL_NETWORK).cross_validate(t.vector_cohort()).metrics


@query(
    "network_cv",
    _VECTORS + """ SELECT target, count(*) AS n_samples, sum(CASE WHEN 'T' || label = target THEN 1 ELSE 0 END)::BIGINT AS n_positive,
    round(avg(CASE WHEN 'T' || label = target THEN 1e0 ELSE 0e0 END), 6) AS prevalence FROM v, g GROUP BY target""",
)
def network_cv(t: Tables):
    rated = network_cv_values(t).select("target", F.col("n_samples").cast("bigint"), F.col("n_positive").cast("bigint"), "prevalence")
    return _round(rated, "prevalence")


@query("network_predict_values")
def network_predict_values(t: Tables):
    return _trained(t).predict(t.vector_cohort())


@query("network_predict", _VECTORS + " SELECT sample_id, target, true AS consistent FROM v, g")
def network_predict(t: Tables):
    right = F.col("probability").between(0, 1) & (F.col("prediction") == (F.col("probability") >= 0.5).cast("int"))
    return network_predict_values(t).select("sample_id", "target", right.alias("consistent"))


@query("embed_values")
def embed_values(t: Tables):
    return _trained(t).embed(t.vector_cohort())


@query("embed", _VECTORS + " SELECT sample_id, 16 AS width, true AS finite FROM v")
def embed(t: Tables):
    return embed_values(t).select("sample_id", F.size("embedding").alias("width"), _all_finite("embedding").alias("finite"))


@query("head_weights_values")
def head_weights_values(t: Tables):
    return _trained(t).head_weights(t.spark)


@query("head_weights", _VECTORS + " SELECT target, 16 AS width, true AS finite FROM g")
def head_weights(t: Tables):
    return head_weights_values(t).select("target", F.size("weights").alias("width"), _all_finite("weights").alias("finite"))


@query("embedding_logits", _VECTORS + " SELECT sample_id, target, true AS equal FROM v, g")
def embedding_logits(t: Tables):
    # A score's logit is the embedding times the head's weights, plus a number that belongs to the target alone.
    model, cohort = _trained(t), t.vector_cohort()
    rows = model.predict(cohort).join(model.embed(cohort), "sample_id").join(model.head_weights(t.spark), "target")
    product = F.aggregate(F.zip_with("embedding", "weights", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    gaps = materialise(rows.select("sample_id", "target", (F.log(F.col("probability") / (1 - F.col("probability"))) - product).alias("gap")), "gaps")
    bias = gaps.groupBy("target").agg(F.avg("gap").alias("bias"))
    return gaps.join(bias, "target").select("sample_id", "target", F.coalesce(F.abs(F.col("gap") - F.col("bias")) < 1e-3, F.lit(False)).alias("equal"))


@query("network_completeness", _VECTORS + " SELECT sample_id, true AS complete FROM v")
def network_completeness(t: Tables):
    # Attributions add up to the row's probability less the background's, within what the draws were stopped at.
    model = _trained(t)
    dense = materialise(model.align(t.vector_cohort()), "dense")
    background = np.array([r["features"] for r in seeded_sample(dense, 50, 1).select("features").collect()])
    found = model.network.expected_gradients(dense, 0, background, draws=2000, tolerance=1e-2)
    return found.select("sample_id", (F.abs("residual") <= 0.02).alias("complete"))


@query("network_attribution_values")
def network_attribution_values(t: Tables):
    return _trained(t).explain(t.vector_cohort(), "T0", "neural", draws=20).summary


@query("network_attribution", _VECTORS + " SELECT 'T0' AS target, 'neural' AS method, feature, true AS consistent FROM h")
def network_attribution(t: Tables):
    within = _finite("mean_shap") & (F.abs("mean_shap") <= F.col("mean_abs_shap") + _CLOSE)
    return network_attribution_values(t).select("target", "method", "feature", within.alias("consistent"))


def _same_scores(one, two):
    """Per sample and target, whether two score tables agree."""
    other = two.select("sample_id", "target", F.col("probability").alias("_other"))
    joined = one.join(other, ["sample_id", "target"], "full")
    return joined.select("sample_id", "target", F.coalesce(F.abs(F.col("probability") - F.col("_other")) < _CLOSE, F.lit(False)).alias("equal"))


@query("bundle_roundtrip_values")
def bundle_roundtrip_values(t: Tables):
    path = _trained(t).save(t.spark, scratch_path(t.spark, "bundle"))
    return MultiLabelModel.load(t.spark, path).predict(t.vector_cohort())


@query("bundle_roundtrip", _VECTORS + " SELECT sample_id, target, true AS equal FROM v, g")
def bundle_roundtrip(t: Tables):
    model, data = _trained(t), t.vector_cohort()
    loaded = MultiLabelModel.load(t.spark, model.save(t.spark, scratch_path(t.spark, "bundle")))
    return _same_scores(model.predict(data), loaded.predict(data))


def _result_bundle(t: Tables) -> str:
    path = scratch_path(t.spark, "burden_run")
    BurdenModel("gradient_boosting", folds=3, n_estimators=5, max_depth=2).cross_validate(t.vector_cohort()).write(path)
    return path


@query("result_bundle_values")
def result_bundle_values(t: Tables):
    return t.spark.read.parquet(f"{_result_bundle(t)}/oof_predictions")


@query(
    "result_bundle",
    _VECTORS + """ SELECT 'oof_predictions' AS name, count(*) AS n FROM v UNION ALL SELECT 'summary', count(DISTINCT cancer) + 1 FROM v
    UNION ALL SELECT 'fold_metrics', count(DISTINCT fold) FROM b""",
)
def result_bundle(t: Tables):
    path = _result_bundle(t)
    parts = [t.spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in ("oof_predictions", "summary", "fold_metrics")]
    return reduce(DataFrame.unionByName, parts)


def _streamed(t: Tables, model: MultiLabelModel):
    rows = t.spark.readStream.schema(t.table("embeddings").schema).parquet(f"{t.directory}/embeddings.parque[t]")
    dense = rows.select(
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("sample_id"),
        F.col("embedding").cast("array<double>").alias("features"),
    )
    return drain(score_stream(model, dense), "stream_scores")


@query("stream_scores_values")
def stream_scores_values(t: Tables):
    return _streamed(t, _trained(t))


@query("stream_scores", _VECTORS + " SELECT sample_id, target, true AS equal FROM v, g")
def stream_scores(t: Tables):
    model = _trained(t)
    return _same_scores(_streamed(t, model), model.predict(t.vector_cohort()))


#: Cells of the vectors as they might arrive: one in eleven is missing.
_ARRIVING = """, cells AS (SELECT 'V' || vec_id AS sample_id, 'G' || lpad(i::VARCHAR, 3, '0') AS gene, v AS value FROM
        (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE (vec_id * 64 + i) % 11 <> 0),
    means AS (SELECT gene, avg(value) AS mean FROM cells GROUP BY gene)"""


def _arriving(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A stream of cells, some of them twice, and the same cells as a table. A last row without a sample moves the time on."""
    flat = t.table("embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "value"))
    flat = flat.withColumn("cell_id", F.col("vec_id") * 64 + F.col("i")).filter("cell_id % 11 != 0")
    cells = flat.select(
        "cell_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id") % 600).alias("ts"), F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("sample_id"),
        F.format_string("G%03d", "i").alias("gene"), "value",
    )
    cells = materialise(cells, "arriving_cells")
    end = cells.limit(1).select(F.lit(-1).cast("bigint").alias("cell_id"), F.timestamp_seconds(F.lit(1_700_100_000)).alias("ts"), F.lit(None).cast("string").alias("sample_id"), F.lit(None).cast("string").alias("gene"), F.lit(None).cast("double").alias("value"))
    path = scratch_path(t.spark, "cell_stream")
    cells.unionByName(cells.filter("cell_id % 7 = 0")).unionByName(end).write.parquet(path)
    return t.spark.readStream.schema(cells.schema).parquet(path), cells.select("sample_id", "gene", "value")


@query("stream_gather", _ARRIVING + """ SELECT s.sample_id, m.gene, round(coalesce(c.value, m.mean), 6) AS value
    FROM (SELECT DISTINCT sample_id FROM cells) s CROSS JOIN means m LEFT JOIN cells c ON c.sample_id = s.sample_id AND c.gene = m.gene""")
def stream_gather(t: Tables):
    stream, cells = _arriving(t)
    means = {r["gene"]: r["mean"] for r in al.feature_stats(cells).collect()}
    names = sorted(means)
    with keyed_state(t.spark):
        dense = drain(gather_samples(stream, names, [means[g] for g in names]), "stream_gather")
    return _round(al.long_rows(dense.select("sample_id", "features"), names), "value")


@query("stream_align_scores", _ARRIVING + " SELECT DISTINCT sample_id, 'T' || label AS target, true AS equal FROM cells, (SELECT DISTINCT label FROM embeddings)")
def stream_align_scores(t: Tables):
    # Scores of samples that were gathered from cells are those of the same cells in a batch.
    model = _trained(t)
    stream, cells = _arriving(t)
    with keyed_state(t.spark):
        dense = drain(gather_samples(stream, model.features, model.feature_means), "stream_align")
    return _same_scores(model.score_dense(dense), model.predict(cells))
