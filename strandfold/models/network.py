"""Shared-encoder multi-label network, trained data-parallel, with its state in a table.

The state (parameters and both moments) of a model is rows of about a megabyte in shared storage, one version per epoch.
Training rows are cut into replicas of bounded size by a hash of their id and stay where they are; every epoch the last
version travels to them, each replica runs minibatch Adam over its own rows, and the resulting chunks are averaged by key,
weighted by rows, into the next version. The driver sees losses. Several models, as those of a cross-validation, are
further keys of the same jobs. A replica takes its rows in an order drawn from the epoch, however they travelled, so a
repeated task repeats its work. The numpy code is only the arithmetic of one minibatch.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import seeded_ordinals
from ..session import checkpoint_by, materialise, shared_dir

# Default settings.
DEFAULTS = {
    "hidden_layers": [512, 256],
    "dropout_rate": 0.3,
    "learning_rate": 0.0005,
    "weight_decay": 0.0003,
    "batch_size": 64,
    "epochs": 100,
    "patience": 6,
    "validation_split": 0.15,
    "gradient_clip": 1.0,
    "use_pos_weight": True,
    "standardize_inputs": True,
    "random_state": 42,
}
NORM_EPS = 1e-5
#: Numbers in a row of the state table.
STATE_CHUNK = 1 << 18
#: Bytes of training rows in a replica: the number of replicas follows the data. The setting ``replicas`` overrides it.
REPLICA_BYTES = 64 << 20
GOLDEN = (5**0.5 - 1) / 2
#: Antithetic pairs of a batch of an attribution, about.
PAIRS = 32
#: Replicas that are averaged together; more take further rounds.
FAN_IN = 32
#: Rows that go through a network at once where none is trained.
SCORED_ROWS = 4096


class Watch:
    """Held-out losses: which version to keep, when to halve the rate, when to stop.

    A version is kept if it betters the lowest loss by an absolute margin. The rate follows a relative margin of its
    own, and is halved once a third of the patience (one epoch at least) has passed without it.
    """

    # The two margins.
    KEEP_MARGIN, RATE_MARGIN = 1e-5, 1e-4

    def __init__(self, rate: float, patience: int):
        self.rate, self.patience = rate, patience
        self.kept: int | None = None
        self._lowest, self._since_kept = np.inf, 0
        self._reference, self._since_better = np.inf, 0

    @property
    def exhausted(self) -> bool:
        return self._since_kept >= self.patience

    def see(self, loss: float, version: int) -> None:
        self._since_kept += 1
        if loss < self._lowest - self.KEEP_MARGIN:
            self.kept, self._lowest, self._since_kept = version, loss, 0
        self._since_better += 1
        if loss < self._reference * (1 - self.RATE_MARGIN):
            self._reference, self._since_better = loss, 0
        elif self._since_better > max(1, self.patience // 3):
            self.rate, self._since_better = self.rate / 2, 0


def resolve_settings(overrides: dict | None = None) -> dict:
    unknown = set(overrides or {}) - set(DEFAULTS) - {"replicas"}
    if unknown:
        raise ValueError(f"Unknown network settings: {sorted(unknown)}")
    return {**DEFAULTS, **(overrides or {})}


# ------------------------------------------------------------------ arithmetic of one batch


def layer_shapes(inputs: int, hidden: list[int], outputs: int) -> list[tuple[str, tuple[int, ...]]]:
    shapes, width = [], inputs
    for i, h in enumerate(hidden):
        shapes += [(f"weight_{i}", (width, h)), (f"bias_{i}", (h,)), (f"gain_{i}", (h,)), (f"shift_{i}", (h,))]
        width = h
    return shapes + [("head", (width, outputs)), ("head_bias", (outputs,))]


def unpack(flat: np.ndarray, shapes) -> dict[str, np.ndarray]:
    parts, at = {}, 0
    for name, shape in shapes:
        size = int(np.prod(shape))
        parts[name] = flat[at : at + size].reshape(shape)
        at += size
    return parts


def initial_parameters(shapes, seed: int) -> np.ndarray:
    """Uniform within 1/sqrt(fan-in) for weights and their biases, identity for the normalisation."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(sum(int(np.prod(s)) for _, s in shapes), dtype="float32")
    fan_in = 1
    for name, part in unpack(flat, shapes).items():
        if name.startswith("gain"):
            part[...] = 1.0
        elif not name.startswith("shift"):
            fan_in = part.shape[0] if part.ndim == 2 else fan_in
            part[...] = rng.uniform(-1.0, 1.0, part.shape) / np.sqrt(fan_in)
    return flat


def _erf(x: np.ndarray) -> np.ndarray:
    # Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7.
    t = 1.0 / (1.0 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1.0 - poly * np.exp(-x * x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def forward(p: dict, x: np.ndarray, depth: int, dropout: float = 0.0, rng=None):
    """Logits, last hidden activations, and what the backward pass needs."""
    kept = []
    for i in range(depth):
        z = x @ p[f"weight_{i}"] + p[f"bias_{i}"]
        centred = z - z.mean(axis=1, keepdims=True)
        inverse = 1.0 / np.sqrt((centred**2).mean(axis=1, keepdims=True) + NORM_EPS)
        normed = centred * inverse
        a = normed * p[f"gain_{i}"] + p[f"shift_{i}"]
        cdf = 0.5 * (1.0 + _erf(a / np.sqrt(2.0)))
        mask = None if not dropout or rng is None else (rng.random(a.shape) >= dropout) / (1.0 - dropout)
        kept.append((x, normed, inverse, a, cdf, mask))
        x = a * cdf if mask is None else a * cdf * mask
    return x @ p["head"] + p["head_bias"], x, kept


def backward(p: dict, hidden: np.ndarray, kept: list, d_logits: np.ndarray):
    """Gradients by layer name, and the gradient at the input."""
    grads = {"head": hidden.T @ d_logits, "head_bias": d_logits.sum(axis=0)}
    d = d_logits @ p["head"].T
    for i in reversed(range(len(kept))):
        x, normed, inverse, a, cdf, mask = kept[i]
        d = d if mask is None else d * mask
        d = d * (cdf + a * np.exp(-0.5 * a * a) / np.sqrt(2.0 * np.pi))
        grads[f"gain_{i}"], grads[f"shift_{i}"] = (d * normed).sum(axis=0), d.sum(axis=0)
        d = d * p[f"gain_{i}"]
        d = inverse * (d - d.mean(axis=1, keepdims=True) - normed * (d * normed).mean(axis=1, keepdims=True))
        grads[f"weight_{i}"], grads[f"bias_{i}"] = x.T @ d, d.sum(axis=0)
        d = d @ p[f"weight_{i}"].T
    return grads, d


def weighted_bce(z: np.ndarray, y: np.ndarray, pos_weight: np.ndarray):
    """Mean loss over all cells, and its gradient at the logits."""
    scale = 1.0 + (pos_weight - 1.0) * y
    loss = (1.0 - y) * z + scale * np.logaddexp(0.0, -z)
    return float(loss.mean()), ((1.0 - y) - scale * sigmoid(-z)) / z.size


def adam_step(state: np.ndarray, grad: np.ndarray, step: int, lr: float, decay: float, clip: float) -> None:
    """In place on rows (parameters, first moment, second moment); decay is part of the gradient."""
    norm = float(np.sqrt((grad.astype("float64") ** 2).sum()))
    grad = grad * min(1.0, clip / (norm + 1e-6)) + decay * state[0]
    state[1] += 0.1 * (grad - state[1])
    state[2] += 0.001 * (grad * grad - state[2])
    m, v = state[1] / (1.0 - 0.9**step), state[2] / (1.0 - 0.999**step)
    state[0] -= lr * m / (np.sqrt(v) + 1e-8)


# ------------------------------------------------------------------ Spark jobs


@dataclass
class Network:
    """A fitted network: parameters, input scaling, settings, training history."""

    inputs: int
    outputs: int
    settings: dict
    parameters: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    history: list[dict] = field(default_factory=list)

    @property
    def shapes(self):
        return layer_shapes(self.inputs, self.settings["hidden_layers"], self.outputs)

    @property
    def depth(self) -> int:
        return len(self.settings["hidden_layers"])

    def head_weights(self) -> np.ndarray:
        return unpack(self.parameters, self.shapes)["head"].T

    def _mapped(self, dense: DataFrame, out: str, compute) -> DataFrame:
        shared = dense.sparkSession.sparkContext.broadcast((self.parameters, self.mean, self.scale))
        shapes, depth = self.shapes, self.depth

        def score(batches):
            parameters, mean, scale = shared.value
            layers = unpack(parameters, shapes)
            for batch in batches:
                if len(batch):
                    x = ((np.stack(batch["features"].to_list()) - mean) / scale).astype("float32")
                    logits, hidden, _ = forward(layers, x, depth)
                    yield pd.DataFrame({"sample_id": batch["sample_id"], out: list(compute(logits, hidden))})

        return dense.select("sample_id", "features").mapInPandas(score, f"sample_id string, {out} array<float>")

    def predict(self, dense: DataFrame) -> DataFrame:
        """``sample_id, probabilities``; works on batch and streaming frames alike."""
        return self._mapped(dense, "probabilities", lambda logits, hidden: sigmoid(logits))

    def embed(self, dense: DataFrame) -> DataFrame:
        """``sample_id, embedding``: the last encoder layer."""
        return self._mapped(dense, "embedding", lambda logits, hidden: hidden)

    def expected_gradients(
        self, dense: DataFrame, target_index: int, background: np.ndarray, draws: int = 200, seed: int = 42, tolerance: float | None = None
    ) -> DataFrame:
        """``sample_id, shap, n_draws, residual``: expected gradients of one target's probability in standardised space.

        Draws come in batches of antithetic pairs: a blend and its mirror image with the same background row. Background
        rows are taken in turn, in an order drawn for each row by its own id. What a draw's attributions add up to
        differs from the difference of the two probabilities by noise of mean 0; with a ``tolerance``, a row stops as
        soon as every background row was used and the standard error of that noise is no larger, at ``draws`` at the latest.
        ``residual`` is by how much the attributions miss the row's probability less the mean one of the background.
        """
        shared = dense.sparkSession.sparkContext.broadcast(
            (self.parameters, self.mean, self.scale, (background - self.mean) / self.scale)
        )
        shapes, depth, outputs = self.shapes, self.depth, self.outputs

        def explain(batches):
            parameters, mean, scale, base = shared.value
            layers = unpack(parameters, shapes)

            def probability(x: np.ndarray) -> np.ndarray:
                return sigmoid(forward(layers, x, depth)[0][:, target_index])

            of_base = probability(base)

            def one(key: str, x: np.ndarray) -> tuple[np.ndarray, int, float]:
                rng, of_row = np.random.default_rng([seed, int(key[:15], 16)]), float(probability(x[None, :])[0])
                order, begins = rng.permutation(len(base)), rng.random(len(base))
                total, noise, pairs = np.zeros(len(x)), [], 0
                # Whole rounds of the background, so that every row of it counts alike.
                size = len(order) * max(1, PAIRS // len(order))
                while 2 * pairs < draws:
                    n = min(size, -(-draws // 2) - pairs)
                    turn, place = np.divmod(np.arange(pairs, pairs + n), len(order))
                    own = order[place]
                    # From round to round the blends of a background row go on by the golden ratio, which spreads them evenly.
                    blend = ((begins[place] + turn * GOLDEN) % 1.0)[:, None]
                    apart = np.tile(x - base[own], (2, 1))
                    blended = np.concatenate([blend, 1.0 - blend]) * apart + np.tile(base[own], (2, 1))
                    logits, hidden, kept = forward(layers, blended, depth)
                    p = sigmoid(logits[:, target_index])
                    d = np.zeros((2 * n, outputs))
                    d[:, target_index] = p * (1.0 - p)
                    parts = apart * backward(layers, hidden, kept, d)[1]
                    total += parts.sum(axis=0)
                    noise.append((parts[:n] + parts[n:]).sum(axis=1) / 2 - (of_row - of_base[own]))
                    pairs += n
                    if tolerance is not None and pairs >= 2 * PAIRS:
                        seen = np.concatenate(noise)
                        if seen.std(ddof=1) / np.sqrt(len(seen)) <= tolerance:
                            break
                shap = total / (2 * pairs)
                return shap, 2 * pairs, float(shap.sum() - (of_row - of_base.mean()))

            for batch in batches:
                found = [one(key, (np.asarray(values) - mean) / scale) for key, values in zip(batch["key"], batch["features"])]
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pd.DataFrame({"sample_id": batch["sample_id"], "shap": list(columns[0]), "n_draws": list(columns[1]), "residual": list(columns[2])})

        keyed = dense.select("sample_id", "features", F.md5("sample_id").alias("key"))
        return keyed.mapInPandas(explain, "sample_id string, shap array<double>, n_draws int, residual double")


@dataclass(frozen=True)
class Scaling:
    """What a model takes from its own training rows: input mean and scale, and the weight of a positive per label."""

    mean: np.ndarray
    scale: np.ndarray
    positive: np.ndarray


def _scalings(rows: DataFrame, models: list[int], settings: dict) -> tuple[dict[int, Scaling], int]:
    """By model, from one pass over ``fold, held, features, labels``; and the most training rows that a model has."""
    vectors = rows.select("fold", "held", array_to_vector("features").alias("x"), array_to_vector("labels").alias("y"))
    found = vectors.groupBy("fold", "held").agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("x")).alias("x"), Summarizer.metrics("sum").summary(F.col("y")).alias("y")
    ).collect()  # a row for each fold and part
    out, most = {}, 0
    for model in models:
        own = [r for r in found if r["fold"] != model]
        if not own:
            raise ValueError("There are no rows to train on.")
        n = np.array([r["x"]["count"] for r in own], dtype=float)
        means, spread = (np.stack([r["x"][k].toArray() for r in own]) for k in ("mean", "variance"))
        mean = n @ means / n.sum()
        std = np.sqrt(((n - 1) @ spread + n @ (means - mean) ** 2) / n.sum())
        trained = [(r["x"]["count"], r["y"]["sum"].toArray()) for r in own if not r["held"]]
        size, positives = sum(t[0] for t in trained), sum(t[1] for t in trained)
        if not (np.isfinite(mean).all() and np.isfinite(std).all() and np.isfinite(positives).all()):
            raise ValueError("Inputs and labels must not have missing or infinite values.")
        weight = np.ones_like(positives)
        if settings["use_pos_weight"]:
            weight = np.clip(np.where(positives > 0, (size - positives) / np.maximum(positives, 1), 1.0), 1.0, 1e6)
        if not settings["standardize_inputs"]:
            mean, std = np.zeros_like(mean), np.ones_like(std)
        out[model], most = Scaling(mean, np.where(std > 0, std, 1.0), weight), max(most, size)
    return out, most


STATE = "model int, chunk int, slice bigint, rows bigint, loss double, steps bigint, part binary"
STATE_NAMES = ["model", "chunk", "slice", "rows", "loss", "steps", "part"]
_STATE_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.binary()]


def _chunks(model: int, slice_: int, flat: np.ndarray, rows: int, loss: float, steps: int) -> pa.Table:
    parts = [flat[at : at + STATE_CHUNK].astype("<f4").tobytes() for at in range(0, flat.size, STATE_CHUNK)]
    columns = [[model] * len(parts), range(len(parts)), [slice_] * len(parts), [rows] * len(parts), [loss] * len(parts), [steps] * len(parts), parts]
    return pa.table([pa.array(c, t) for c, t in zip(columns, _STATE_TYPES, strict=True)], names=STATE_NAMES)


_NOTHING = pa.table([pa.array([], t) for t in _STATE_TYPES], names=STATE_NAMES)


def _flat(chunks: pa.Table) -> np.ndarray:
    order = np.argsort(chunks.column("chunk").to_numpy())
    parts = chunks.column("part").to_pylist()
    return np.concatenate([np.frombuffer(parts[i], dtype="<f4") for i in order])


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Part by part into one array: beside the column itself, nothing else of its size is held."""
    parts = [c for c in column.chunks if len(c)]
    out = np.empty((len(column), len(parts[0].flatten()) // len(parts[0]) if parts else 0), dtype=kind)
    at = 0
    for part in parts:
        out[at : at + len(part)] = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
        at += len(part)
    return out


def _logits(layers: dict, rows: pa.Table, scaling: Scaling, depth: int) -> np.ndarray:
    """Of all rows, a bounded number at a time."""
    found = []
    for at in range(0, rows.num_rows, SCORED_ROWS):
        x = _matrix(rows.column("features").slice(at, SCORED_ROWS), "float64")
        found.append(forward(layers, ((x - scaling.mean) / scaling.scale).astype("float32"), depth)[0])
    return np.concatenate(found)


def _averaged(state: DataFrame, slices: int) -> DataFrame:
    """One row per model and chunk: the mean over slices, weighted by rows, FAN_IN slices at a time."""

    def average(parts: pa.Table) -> pa.Table:
        rows = parts.column("rows").to_numpy()
        mean = sum(w * np.frombuffer(p.as_py(), dtype="<f4") for w, p in zip(rows / rows.sum(), parts.column("part"), strict=True))
        first = {c: parts.column(c)[0].as_py() for c in ("model", "chunk", "slice")}
        values = [*first.values(), int(rows.sum()), float(np.sum(parts.column("loss").to_numpy())), int(np.max(parts.column("steps").to_numpy())), mean.astype("<f4").tobytes()]
        return pa.table([pa.array([v], t) for v, t in zip(values, _STATE_TYPES, strict=True)], names=STATE_NAMES)

    while slices > 1:
        slices = -(-slices // FAN_IN)
        state = state.withColumn("slice", F.expr(f"slice div {FAN_IN}")).groupBy("model", "chunk", "slice").applyInArrow(average, STATE)
    return state


@dataclass(frozen=True)
class Replicas:
    """Rows of some part, in cells of one model and slice each, checkpointed where they will be used."""

    rows: DataFrame
    slices: int

    @staticmethod
    def of(rows: DataFrame, models: int, slices: int) -> Replicas:
        """``rows`` has a column ``model``. A checkpoint keeps the partitions, so only the state moves from then on."""
        key = F.xxhash64("sample_id")
        cell = F.col("model") * slices + F.pmod(F.xxhash64("sample_id", F.lit(slices)), F.lit(slices))
        placed = rows.select(cell.cast("bigint").alias("cell"), key.alias("key"), "sample_id", "features", "labels")
        return Replicas(checkpoint_by(placed, models * slices, "cell"), slices)

    def meet(self, state: DataFrame, work, schema: str) -> DataFrame:
        """``work(model, slice, rows, chunks)`` for every cell that has rows and a state."""
        slices, nothing = self.slices, None

        def run(key, rows: pa.Table, chunks: pa.Table) -> pa.Table:
            model, slice_ = divmod(key[0].as_py(), slices)
            return work(model, slice_, rows if rows.num_rows and chunks.num_rows else nothing, chunks)

        sent = state.select("model", "chunk", "steps", "part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("at"))
        sent = sent.select((F.col("model") * slices + F.col("at")).cast("bigint").alias("cell"), "chunk", "steps", "part")
        return self.rows.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(run, schema)


LOSS = "model int, loss double, rows bigint"
SCORED = "sample_id string, probabilities array<float>, fold bigint"


class Training:
    """Models that learn side by side: model m from the rows of all folds but m."""

    def __init__(self, rows: DataFrame, models: list[int], settings: dict, validate: bool):
        """``rows``: sample_id, fold, features, labels; a seeded share of every fold is held out for ``validate``."""
        self.settings, self.models, self.validate = settings, models, validate
        rows = rows.select("sample_id", F.col("fold").cast("int").alias("fold"), "features", "labels").withColumn("held", F.lit(False))
        if validate:
            ranked = seeded_ordinals(rows.drop("held"), "sample_id", settings["random_state"], "fold")
            rows = ranked.withColumn("held", F.col("ordinal") <= F.ceil(F.col("total") * F.lit(settings["validation_split"]))).drop("ordinal", "total")
        self.rows = rows.checkpoint()
        self.scalings, most = _scalings(self.rows, models, settings)
        one = self.scalings[models[0]]
        self.inputs, self.outputs = len(one.mean), len(one.positive)
        self.shapes = layer_shapes(self.inputs, settings["hidden_layers"], self.outputs)
        self.size = sum(int(np.prod(s)) for _, s in self.shapes)
        self.slices = settings.get("replicas") or max(1, -(-most * (8 * self.inputs + 4 * self.outputs) // REPLICA_BYTES))
        self.history: dict[int, list[dict]] = {m: [] for m in models}
        self.versions: list[DataFrame] = []
        self.final = {m: 0 for m in models}

    def _of_models(self, held: bool) -> DataFrame:
        """Rows of one part, once for each model that they are for."""
        models = F.filter(F.array(*[F.lit(m) for m in self.models]), lambda m: m != F.col("fold"))
        return self.rows.filter(F.col("held") == held).withColumn("model", F.explode(models))

    def _shared(self):
        return self.rows.sparkSession.sparkContext.broadcast(self.scalings)

    def first_version(self) -> DataFrame:
        """Every model starts from the same drawn parameters, made by one task a model and written chunk by chunk."""
        shapes, seed, size = self.shapes, self.settings["random_state"], self.size

        def make(batches):
            for batch in batches:
                for model in batch.column(0).to_pylist():
                    flat = np.concatenate([initial_parameters(shapes, seed), np.zeros(2 * size, dtype="float32")])
                    yield from _chunks(model, 0, flat, 0, 0.0, 0).to_batches()

        spark = self.rows.sparkSession
        named = spark.range(len(self.models)).select(F.element_at(F.array(*[F.lit(m) for m in self.models]), (F.col("id") + 1).cast("int")).alias("model"))
        return materialise(named.mapInArrow(make, STATE), "network_state")

    def epoch(self, data: Replicas, state: DataFrame, number: int, rates: dict[int, float]) -> DataFrame:
        """The next version: every replica passes once over its rows, and the results are averaged."""
        settings, shapes, depth, shared = self.settings, self.shapes, len(self.settings["hidden_layers"]), self._shared()

        def train(model: int, slice_: int, rows: pa.Table | None, chunks: pa.Table) -> pa.Table:
            if rows is None or model not in rates:
                return _NOTHING
            scaling, local = shared.value[model], _flat(chunks).reshape(3, -1).copy()
            layers, rng = unpack(local[0], shapes), np.random.default_rng([settings["random_state"], number, slice_])
            # By id first, then drawn: however the rows came.
            order = rng.permutation(rows.num_rows)
            order = np.argsort(rows.column("key").to_numpy(), kind="stable")[order]
            x_all, y_all = _matrix(rows.column("features"), "float64"), _matrix(rows.column("labels"), "float32")
            steps, total, size = chunks.column("steps")[0].as_py(), 0.0, settings["batch_size"]
            for at in range(0, len(order), size):
                own = order[at : at + size]
                x = ((x_all[own] - scaling.mean) / scaling.scale).astype("float32")
                logits, hidden, kept = forward(layers, x, depth, settings["dropout_rate"], rng)
                loss, d_logits = weighted_bce(logits, y_all[own], scaling.positive)
                grads, _ = backward(layers, hidden, kept, d_logits)
                steps += 1
                flat = np.concatenate([grads[name].ravel() for name, _ in shapes]).astype("float32")
                adam_step(local, flat, steps, rates[model], settings["weight_decay"], settings["gradient_clip"])
                total += loss * len(own)
            return _chunks(model, slice_, local.ravel(), len(order), total, steps)

        following = materialise(_averaged(data.meet(state, train, STATE), self.slices), "network_state")
        shared.unpersist()
        return following

    def losses(self, state: DataFrame, held: Replicas | None) -> dict[tuple[str, int], float]:
        """Mean training loss of the epoch, and held-out loss after it, by model: all that comes to the driver."""
        shapes, depth, shared, size = self.shapes, len(self.settings["hidden_layers"]), self._shared(), self.size

        def measure(model: int, slice_: int, rows: pa.Table | None, chunks: pa.Table) -> pa.Table:
            found = ([], [], [])
            if rows is not None:
                scaling = shared.value[model]
                loss, _ = weighted_bce(_logits(unpack(_flat(chunks)[:size], shapes), rows, scaling, depth), _matrix(rows.column("labels"), "float32"), scaling.positive)
                found = ([model], [loss * rows.num_rows], [rows.num_rows])
            return pa.table([pa.array(found[0], pa.int32()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.int64())], names=["model", "loss", "rows"])

        both = state.filter("chunk = 0").select("model", F.lit("train_loss").alias("kind"), "loss", "rows")
        if held is not None:
            both = both.unionByName(held.meet(self._parameters(state), measure, LOSS).withColumn("kind", F.lit("validation_loss")))
        rows = both.groupBy("model", "kind").agg((F.sum("loss") / F.sum("rows")).alias("loss")).collect()
        shared.unpersist()
        return {(r["kind"], r["model"]): r["loss"] for r in rows}

    def _parameters(self, state: DataFrame) -> DataFrame:
        """The chunks that hold parameters, without those of moments only."""
        return state.filter(F.col("chunk") * STATE_CHUNK < self.size)

    def run(self) -> Training:
        data = Replicas.of(self._of_models(False), max(self.models) + 1, self.slices)
        held = Replicas.of(self._of_models(True), max(self.models) + 1, self.slices) if self.validate else None
        watches = {m: Watch(self.settings["learning_rate"], self.settings["patience"]) for m in self.models}
        state, active = self.first_version(), set(self.models)
        self.versions = [state]
        for number in range(1, self.settings["epochs"] + 1):
            state = self.epoch(data, state.filter(F.col("model").isin(sorted(active))), number, {m: watches[m].rate for m in active})
            self.versions.append(state)
            found = self.losses(state, held)
            for m in sorted(active):
                entry = {"epoch": number, "train_loss": found["train_loss", m]}
                self.final[m] = number
                if held is not None:
                    entry["validation_loss"] = found.get(("validation_loss", m), 0.0)
                    watches[m].see(entry["validation_loss"], number)
                    entry["learning_rate"] = watches[m].rate
                self.history[m].append(entry)
            active = {m for m in active if not watches[m].exhausted}
            if not active:
                break
        self.final = {m: watches[m].kept or self.final[m] for m in self.models}
        return self

    def final_state(self, models: list[int]) -> DataFrame:
        """Parameter chunks of each model's version that counts."""
        parts = [self._parameters(self.versions[v]).filter(F.col("model").isin([m for m in models if self.final[m] == v])) for v in sorted({self.final[m] for m in models})]
        return reduce(DataFrame.unionByName, parts)

    def network(self, model: int) -> Network:
        """A model on its own. Its parameters, bounded by the settings, come to the driver here and nowhere else."""
        scaling = self.scalings[model]
        flat = _flat(self.final_state([model]).select("chunk", "part").toArrow())[: self.size].copy()
        return Network(self.inputs, self.outputs, self.settings, flat, scaling.mean, scaling.scale, self.history[model])

    def score_folds(self) -> DataFrame:
        """``sample_id, probabilities, fold``: every row by the model of its own fold, which has not seen it."""
        shapes, depth, shared, size = self.shapes, len(self.settings["hidden_layers"]), self._shared(), self.size
        own = Replicas.of(self.rows.withColumn("model", F.col("fold")), max(self.models) + 1, self.slices)

        def score(model: int, slice_: int, rows: pa.Table | None, chunks: pa.Table) -> pa.Table:
            ids, values = pa.array([], pa.string()), pa.array([], pa.list_(pa.float32()))
            if rows is not None:
                p = sigmoid(_logits(unpack(_flat(chunks)[:size], shapes), rows, shared.value[model], depth)).astype("float32")
                ids = rows.column("sample_id").combine_chunks()
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.reshape(-1)))
            return pa.table([ids, values, pa.array([model] * len(ids), pa.int64())], names=["sample_id", "probabilities", "fold"])

        return own.meet(self.final_state(self.models), score, SCORED)


def fit_network(dense: DataFrame, overrides: dict | None = None, validate: bool = False) -> Network:
    """Train on ``sample_id, features, labels``.

    ``validate`` holds out a seeded share, halves the rate on a plateau, stops early and restores the best
    state; otherwise the number of epochs is fixed. The input scaling is taken from all given rows.
    """
    shared_dir(dense.sparkSession)
    return Training(dense.withColumn("fold", F.lit(0)), [1], resolve_settings(overrides), validate).run().network(1)


def fit_folds(rows: DataFrame, folds: int, overrides: dict | None = None) -> Training:
    """Train a model for each of the folds 1, 2, ... of ``sample_id, fold, features, labels``, in the same jobs."""
    shared_dir(rows.sparkSession)
    return Training(rows, list(range(1, folds + 1)), resolve_settings(overrides), True).run()
