from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandfold import BurdenModel, Cohort, MultiLabelModel
from strandfold.models import network as net
from strandfold.models.explain import explain_cohort
from strandfold.models.trees import base_value, leaf_paths, make_classifier, make_regressor, shapley_values, with_vector
from strandfold.operators.folds import seeded_sample

FAST = {"hidden_layers": [10, 6], "batch_size": 12, "epochs": 3, "folds": 4}
SAMPLES, GENES = 48, 10


@pytest.fixture(scope="module")
def cohort(spark):
    """Two genes on a circle decide a target and the burden; two more targets follow other genes or nothing."""
    rows = []
    for i in range(SAMPLES):
        angle = 2 * np.pi * ((i * 7) % SAMPLES) / SAMPLES
        genes = {f"G{j}": float(np.sin(angle * (j + 1) + j)) if j > 1 else float([np.cos(angle), np.sin(angle)][j]) for j in range(GENES)}
        rows.append((f"S{i}", genes, {"TP53": genes["G0"] > 0.1, "MYC": genes["G4"] > 0.5, "ATM": i % 3 == 0}, int(40 + 30 * genes["G0"])))
    values = [(s, g, v) for s, genes, _, _ in rows for g, v in genes.items()]
    calls = [(s, t, int(y)) for s, _, labels, _ in rows for t, y in labels.items()]
    counts = [(s, n, float(np.log2(n + 1))) for s, _, _, n in rows]
    frames = (
        spark.createDataFrame(values, "sample_id string, gene string, value double"),
        spark.createDataFrame(calls, "sample_id string, target string, label int"),
        spark.createDataFrame(counts, "sample_id string, tmb bigint, tmb_log2 double"),
    )
    return Cohort.from_tables(*[f.cache() for f in frames])


# ------------------------------------------------------------------ network arithmetic


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(1)
    shapes = net.layer_shapes(5, [7, 4], 3)
    flat = net.initial_parameters(shapes, 0).astype("float64") + 0.05 * rng.normal(size=sum(int(np.prod(s)) for _, s in shapes))
    x, y, weight = rng.normal(size=(6, 5)), (rng.random((6, 3)) < 0.5).astype(float), np.array([1.0, 3.0, 2.0])

    def loss(parameters, values=x):
        return net.weighted_bce(net.forward(net.unpack(parameters, shapes), values, 2)[0], y, weight)[0]

    layers = net.unpack(flat, shapes)
    logits, hidden, kept = net.forward(layers, x, 2)
    grads, d_input = net.backward(layers, hidden, kept, net.weighted_bce(logits, y, weight)[1])
    analytic = np.concatenate([grads[n].ravel() for n, _ in shapes])
    step = 1e-5
    for i in rng.choice(flat.size, 60, replace=False):
        e = np.zeros(flat.size)
        e[i] = step
        assert analytic[i] == pytest.approx((loss(flat + e) - loss(flat - e)) / (2 * step), abs=2e-4)
    e = np.zeros(x.shape)
    e[2, 3] = step
    assert d_input[2, 3] == pytest.approx((loss(flat, x + e) - loss(flat, x - e)) / (2 * step), abs=2e-4)


def test_weighted_loss_by_hand():
    loss, grad = net.weighted_bce(np.array([[0.0, 0.0]]), np.array([[1.0, 0.0]]), np.array([3.0, 3.0]))
    assert loss == pytest.approx((3 * np.log(2) + np.log(2)) / 2)
    assert grad.tolist() == [[pytest.approx(-0.75), pytest.approx(0.25)]]


def test_adam_first_step_moves_by_the_rate():
    state = np.zeros((3, 2))
    net.adam_step(state, np.array([3.0, -4.0]), 1, 0.1, 0.0, 1.0)
    assert state[0] == pytest.approx([-0.1, 0.1], abs=1e-6)


def planted(spark, n=240):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 6))
    y = np.c_[x[:, 0] > 0, x[:, 1] + x[:, 2] > 0].astype(float)
    rows = [(f"s{i}", [float(v) for v in x[i]], [float(v) for v in y[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, features array<double>, labels array<double>"), y


@pytest.mark.parametrize("replicas", [1, 3])
def test_network_learns_a_planted_signal(spark, replicas):
    dense, y = planted(spark)
    model = net.fit_network(dense, {"hidden_layers": [16], "epochs": 12, "batch_size": 16, "learning_rate": 0.01, "replicas": replicas})
    losses = [h["train_loss"] for h in model.history]
    assert len(losses) == 12 and losses[-1] < 0.6 * losses[0]
    p = {r["sample_id"]: r["probabilities"] for r in model.predict(dense).collect()}
    hits = np.mean([(p[f"s{i}"][t] >= 0.5) == bool(y[i, t]) for i in range(len(y)) for t in range(2)])
    assert hits > 0.9


def test_validated_fit_is_repeatable_and_stops_early(spark):
    dense, _ = planted(spark, 80)
    settings = {"hidden_layers": [8], "epochs": 6, "patience": 2, "learning_rate": 0.2, "batch_size": 16}
    runs = [net.fit_network(dense.repartition(n), settings, validate=True) for n in (1, 5)]
    assert np.allclose(runs[0].parameters, runs[1].parameters)
    assert all({"validation_loss", "learning_rate"} <= set(h) for h in runs[0].history)


def test_missing_values_and_unknown_settings_are_errors(spark):
    bad = spark.createDataFrame([("a", [1.0, float("nan")], [1.0]), ("b", [1.0, 2.0], [0.0])], "sample_id string, features array<double>, labels array<double>")
    with pytest.raises(ValueError, match="missing or infinite"):
        net.fit_network(bad, {"epochs": 1})
    with pytest.raises(ValueError, match="Unknown network settings"):
        MultiLabelModel(depth=3)


# ------------------------------------------------------------------ model classes


def test_fit_predict_embed_and_round_trip(spark, cohort, tmp_path):
    train = cohort.subset(samples=[f"S{i}" for i in range(36)])
    model = MultiLabelModel(**FAST).fit(train)
    held_out = cohort.without(train.samples)
    scores = model.predict(held_out)
    assert scores.count() == 36 and {r["target"] for r in scores.collect()} == {"TP53", "MYC", "ATM"}
    assert model.predict(held_out.expression).count() == 36 and model.feature_overlap == 1.0
    assert {len(r["embedding"]) for r in model.embed(held_out).collect()} == {FAST["hidden_layers"][-1]}
    weights = model.head_weights(spark).collect()
    assert [r["target"] for r in weights] == ["ATM", "MYC", "TP53"] and len(weights[0]["weights"]) == FAST["hidden_layers"][-1]
    path = model.save(spark, str(tmp_path / "model"))
    again = MultiLabelModel.load(spark, path)
    both = scores.join(again.predict(held_out).withColumnRenamed("probability", "p2"), ["sample_id", "target"])
    assert both.agg(F.max(F.abs(F.col("probability") - F.col("p2")))).first()[0] < 1e-6
    assert again.metadata["cancers"] == ["cohort"] and len(again.network.history) == FAST["epochs"]


def test_unfitted_and_disjoint(spark, cohort):
    with pytest.raises(ValueError, match="not fitted"):
        MultiLabelModel().predict(cohort)
    model = MultiLabelModel(**{**FAST, "epochs": 1}).fit(cohort)
    other = cohort.expression.withColumn("gene", F.concat("gene", F.lit("_other")))
    with pytest.raises(ValueError, match="feature overlap"):
        model.predict(other)
    with pytest.raises(ValueError, match="not in this model"):
        model.explain(cohort, "NOPE")
    with pytest.raises(ValueError, match="Method must be"):
        model.explain(cohort, "TP53", "guess")
    with pytest.raises(ValueError, match="labels are required"):
        MultiLabelModel().fit(Cohort(cohort.samples, cohort.expression))


def test_mutation_cross_validation(spark, cohort, tmp_path):
    result = MultiLabelModel(**FAST).cross_validate(cohort)
    assert result.scores.count() == 144 and result.scores.select("sample_id", "target").distinct().count() == 144
    assert {r["target"] for r in result.metrics.collect()} == {"TP53", "MYC", "ATM"}
    assert {"auprc", "normalized_auprc", "roc_auc", "mcc"} <= set(result.metrics.columns)
    assert result.metadata["split_method"] == "shuffled_kfold" and result.folds.count() == SAMPLES
    result.write(str(tmp_path / "cv"))
    assert spark.read.parquet(str(tmp_path / "cv" / "oof_scores")).count() == 144


@pytest.mark.parametrize("kind", ["random_forest", "gradient_boosting"])
def test_burden_model(spark, cohort, kind):
    model = BurdenModel(kind, n_estimators=5, max_depth=3, folds=3).fit(cohort)
    rows = model.predict(cohort)
    assert rows.columns == ["sample_id", "tmb_log2_pred", "tmb_pred"] and rows.count() == SAMPLES
    result = model.cross_validate(cohort)
    summary = {r["cancer"]: r for r in result.summary.collect()}
    assert set(summary) == {"__OVERALL__", "cohort"} and summary["__OVERALL__"]["spearman"] > 0.2
    assert result.predictions.select("sample_id").distinct().count() == SAMPLES
    assert sorted(r["fold"] for r in result.fold_metrics.collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="feature overlap"):
        model.predict(cohort.expression.withColumn("gene", F.concat("gene", F.lit("_x"))))


def test_burden_model_errors_and_unlabelled_samples(spark, cohort):
    with pytest.raises(ValueError, match="Tree model"):
        BurdenModel("not_a_model")
    some = Cohort(cohort.samples, cohort.expression, tmb=cohort.tmb.withColumn("tmb_log2", F.when(F.col("sample_id") != "S0", F.col("tmb_log2"))))
    result = BurdenModel("random_forest", n_estimators=2, max_depth=2, folds=3).cross_validate(some)
    assert result.predictions.count() == SAMPLES - 1


# ------------------------------------------------------------------ attribution


def brute_shapley(x, paths, features):
    def value(known):
        total = 0.0
        for group in paths:
            for v, f, low, high, reach in zip(group.value, group.feature, group.low, group.high, group.reach):
                share = 1.0
                for j, lo, hi, z in zip(f, low, high, reach):
                    share *= float(lo < x[j] <= hi) if j in known else z
                total += v * share
        return total

    result = np.zeros(features)
    for i in range(features):
        others = [j for j in range(features) if j != i]
        for size in range(features):
            for chosen in combinations(others, size):
                weight = factorial(size) * factorial(features - size - 1) / factorial(features)
                result[i] += weight * (value({*chosen, i}) - value(set(chosen)))
    return result


@pytest.mark.parametrize("kind", ["gradient_boosting", "random_forest"])
@pytest.mark.parametrize("task", ["class", "regression"])
def test_tree_shap_is_exact(spark, kind, task):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(70, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    rows = [(f"s{i}", [float(v) for v in x[i]], float(y[i]), float(1 + i % 3)) for i in range(70)]
    df = with_vector(spark.createDataFrame(rows, "sample_id string, features array<double>, label double, weight double"))
    params = {"n_estimators": 4, "max_depth": 4}
    make = make_classifier if task == "class" else make_regressor
    model = make(kind, params).fit(df)
    paths = leaf_paths(spark, model)
    got = shapley_values(x[:5], paths)
    for i in range(5):
        assert got[i] == pytest.approx(brute_shapley(x[i], paths, 4), abs=1e-9)
    scored = model.transform(df).orderBy(F.expr("cast(substring(sample_id, 2) as int)")).limit(5).collect()
    if task == "regression":
        margin = [r["prediction"] for r in scored]
    elif kind == "random_forest":
        margin = [r["probability"][1] for r in scored]
    else:
        margin = [0.5 * np.log(r["probability"][1] / r["probability"][0]) for r in scored]
    assert got.sum(axis=1) + base_value(paths) == pytest.approx(np.array(margin), abs=1e-6)


@pytest.mark.parametrize("method", ["gradient_boosting", "random_forest", "neural"])
def test_explanations(spark, cohort, method, tmp_path):
    model = MultiLabelModel(**{**FAST, "epochs": 30, "learning_rate": 0.01}).fit(cohort)
    options = {"params": {"n_estimators": 8, "max_depth": 3}} if method != "neural" else {"draws": 30}
    result = model.explain(cohort, "TP53", method, max_samples=12, top_features=3, **options)
    summary = result.summary.orderBy("rank").collect()
    assert len(summary) == GENES and summary[0]["feature"] in {"G0", "G1"}
    assert result.sample_values.count() == 36 and result.metadata["n_explained_samples"] == 12
    assert result.sample_values.filter(F.col("expression_value").isNull()).count() == 0
    result.write(str(tmp_path / method))
    assert spark.read.parquet(str(tmp_path / method / "feature_summary")).count() == GENES


def test_one_class_target_is_an_error(spark, cohort):
    calls = cohort.mutations.withColumn("label", F.lit(1))
    data = Cohort(cohort.samples, cohort.expression, calls)
    model = MultiLabelModel(**{**FAST, "epochs": 1}).fit(data)
    with pytest.raises(ValueError, match="one class"):
        model.explain(data, "TP53")


def test_expected_gradients_add_up(spark):
    dense, _ = planted(spark, 60)
    model = net.fit_network(dense, {"hidden_layers": [8], "epochs": 5, "batch_size": 16, "learning_rate": 0.02})
    background = np.array([r["features"] for r in dense.limit(40).collect()])
    explained = dense.filter("sample_id in ('s1', 's2', 's3')")
    got = {r["sample_id"]: sum(r["shap"]) for r in model.expected_gradients(explained, 0, background, draws=4000).collect()}
    p = {r["sample_id"]: r["probabilities"][0] for r in model.predict(explained).collect()}
    base = spark.createDataFrame([("b%d" % i, [float(v) for v in b]) for i, b in enumerate(background)], "sample_id string, features array<double>")
    mean = np.mean([r["probabilities"][0] for r in model.predict(base).collect()])
    for key, total in got.items():
        assert total == pytest.approx(p[key] - mean, abs=0.05)


def test_watch_keeps_halves_and_stops():
    watch = net.Watch(0.8, 6)
    for version, loss in enumerate([1.0, 0.5, 0.499999, 0.6, 0.6]):
        watch.see(loss, version)
    assert watch.kept == 1 and watch.rate == 0.4 and not watch.exhausted
    for version in range(5, 8):
        watch.see(0.7, version)
    assert watch.exhausted and watch.rate == 0.2 and watch.kept == 1


def test_training_does_not_depend_on_transport(spark):
    dense, _ = planted(spark, 100)
    settings = {"hidden_layers": [6], "epochs": 3, "batch_size": 16, "replicas": 3}
    first = net.fit_network(dense, settings)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        second = net.fit_network(dense, settings)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert np.allclose(first.parameters, second.parameters, atol=1e-6)


def test_trees_are_explained_without_a_network_and_in_many_tasks(spark, cohort):
    result = explain_cohort(cohort, "TP53", "random_forest", params={"n_estimators": 4, "max_depth": 3})
    assert result.metadata["n_explained_samples"] == SAMPLES and result.sample_values.select("sample_id").distinct().count() == SAMPLES
    dense, _ = planted(spark)
    part = seeded_sample(dense.repartition(8), 50, 1)
    assert part.count() == 50 and part.rdd.getNumPartitions() > 1


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_folds_are_keys_of_the_same_jobs(spark):
    dense, _ = planted(spark, 120)
    settings = {"hidden_layers": [6], "epochs": 2, "batch_size": 16}
    counts = {}
    for k in (2, 5):
        rows = dense.withColumn("fold", F.pmod(F.crc32("sample_id"), F.lit(k)) + 1).cache()
        rows.count()
        counts[k] = jobs_of(spark, f"folds {k}", lambda rows=rows, k=k: net.fit_folds(rows, k, settings).score_folds().write.format("noop").mode("overwrite").save())
    assert counts[5] <= counts[2]


def test_a_fold_is_scored_by_a_model_that_has_not_seen_it(spark):
    dense, _ = planted(spark, 90)
    rows = dense.withColumn("fold", F.pmod(F.crc32("sample_id"), F.lit(3)) + 1).cache()
    settings = {"hidden_layers": [6], "epochs": 3, "batch_size": 16, "replicas": 2}
    trained = net.fit_folds(rows, 3, settings)
    scored = {r["sample_id"]: r for r in trained.score_folds().collect()}
    assert len(scored) == 90 and {r["sample_id"]: r["fold"] for r in rows.collect()} == {k: r["fold"] for k, r in scored.items()}
    for fold in (1, 3):
        own = trained.network(fold)
        again = {r["sample_id"]: r["probabilities"] for r in own.predict(rows.filter(F.col("fold") == fold)).collect()}
        assert again and all(np.allclose(scored[k]["probabilities"], v, atol=1e-5) for k, v in again.items())
    # Other labels in a fold change the other models, not its own.
    flipped = rows.withColumn("labels", F.when(F.col("fold") == 2, F.transform("labels", lambda v: 1 - v)).otherwise(F.col("labels")))
    other = net.fit_folds(flipped, 3, settings)
    assert np.allclose(other.network(2).parameters, trained.network(2).parameters, atol=1e-6)
    assert not np.allclose(other.network(1).parameters, trained.network(1).parameters, atol=1e-4)


def test_averaging_many_slices_in_rounds(spark):
    rng = np.random.default_rng(3)
    parts, rows = rng.normal(size=(70, 5)).astype("float32"), rng.integers(1, 9, 70)
    state = spark.createDataFrame([(1, 0, i, int(rows[i]), float(i), i % 7, parts[i].tobytes()) for i in range(70)], net.STATE)
    got = net._averaged(state, 70).collect()
    assert len(got) == 1 and got[0]["rows"] == rows.sum() and got[0]["loss"] == sum(range(70)) and got[0]["steps"] == 6
    assert np.allclose(np.frombuffer(got[0]["part"], dtype="<f4"), (rows @ parts) / rows.sum(), atol=1e-5)


def test_training_rows_stay_where_they_are(spark):
    dense, _ = planted(spark, 60)
    run = net.Training(dense.withColumn("fold", F.lit(0)), [1], net.resolve_settings({"hidden_layers": [4], "replicas": 3}), False)
    data, state = net.Replicas.of(run._of_models(False), 2, run.slices), run.first_version()
    plan = data.meet(state, lambda m, s, rows, chunks: chunks.select([]), "model int")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_attributions_stop_when_they_are_complete(spark):
    dense, _ = planted(spark, 60)
    model = net.fit_network(dense, {"hidden_layers": [8], "epochs": 5, "batch_size": 16, "learning_rate": 0.02})
    background = np.array([r["features"] for r in dense.limit(20).collect()])
    loose, tight = (model.expected_gradients(dense, 1, background, draws=6000, tolerance=e).collect() for e in (2e-2, 4e-3))
    assert all(abs(r["residual"]) < 2e-2 for r in loose) and all(abs(r["residual"]) < 4e-3 for r in tight)
    assert sum(r["n_draws"] for r in loose) < sum(r["n_draws"] for r in tight)
    p = {r["sample_id"]: r["probabilities"][1] for r in model.predict(dense).collect()}
    base = np.mean([p[r["sample_id"]] for r in dense.limit(20).collect()])
    for r in tight:
        assert sum(r["shap"]) - r["residual"] == pytest.approx(p[r["sample_id"]] - base, abs=1e-4)


def test_rows_of_a_replica_are_scored_a_few_at_a_time(monkeypatch):
    # Before, the scaled copies of all rows of a replica were held at once.
    import pyarrow as pa

    from strandfold.models import network as nn

    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))
    parts = [pa.array(p.tolist(), pa.list_(pa.float64())) for p in np.array_split(x, 4)]
    column = pa.chunked_array([*parts, pa.array([], pa.list_(pa.float64()))])
    assert (nn._matrix(column, "float64") == x).all() and nn._matrix(column.slice(5, 40), "float32").dtype == "float32"
    shapes = nn.layer_shapes(4, [3], 2)
    layers, scaling = nn.unpack(nn.initial_parameters(shapes, 1), shapes), nn.Scaling(x.mean(0), x.std(0), np.ones(2))
    seen, whole = [], nn.forward
    want = whole(layers, ((x - scaling.mean) / scaling.scale).astype("float32"), 1)[0]
    monkeypatch.setattr(nn, "forward", lambda p, rows, *a: seen.append(len(rows)) or whole(p, rows, *a))
    monkeypatch.setattr(nn, "SCORED_ROWS", 16)
    got = nn._logits(layers, pa.table({"features": column}), scaling, 1)
    assert max(seen) == 16 and sum(seen) == 90 and got == pytest.approx(want, abs=1e-6)
