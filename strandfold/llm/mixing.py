"""Mixing sources to target weights by iterative proportional fitting, then sampling by the fitted probabilities.

Tokens are summed per cell (a combination of source, language and topic). Cell weights are raked: each dimension in turn
is scaled so that its marginal equals its target, until all marginals fit. A document of a cell is kept with a
probability in proportion to the cell's weight per token; the largest probability is 1, or lower if ``keep_tokens`` asks
for less. The draw is a hash of the id and the seed, so a repeated task draws the same.

Everything is DataFrame operations. Cells are few next to documents, but nothing assumes that they are very few:
marginals are aggregated with partial sums and joined back by Spark's own choice of join, and each round is stored.

Defined cases: a null in a dimension is a value of its own, ''; a target for a value that no token has is spread over
the others in proportion, as are targets that do not sum to 1; a value without a target keeps target 0 and is never
drawn; a null text has no tokens, and documents without tokens are drawn with their cell's probability (0 tokens do not
count in any marginal); rows that repeat an id share its draw; a null id draws by its text; an empty table gives no rows.
Columns of the input with the names of added columns are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cohort import scalar
from ..session import materialise
from .common import broadcast_if_small, without

DIMENSIONS = ("source", "lang", "topic")
ADDED = ("topic", "n_tokens", "probability", "sampled")
#: Raking that has not come within the tolerance after so many rounds is an error: the targets contradict the cells.
ROUNDS, TOLERANCE = 200, 1e-6


def token_count(text: str = "text") -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def topic(text: str = "text") -> Column:
    """A coarse topic by form: shouting, code and figures, notes (under 50 words), essays (1000 and more) or articles."""
    whole, size = F.coalesce(F.col(text), F.lit("")), F.greatest(F.length(text), F.lit(1))
    upper = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    odd = F.length(whole) - F.length(F.translate(whole, "0123456789#*$%&|<>{}[]=", ""))
    return (
        F.when(upper > 0.4 * size, "shouting").when(odd > 0.05 * size, "figures")
        .when(F.col("n_tokens") < 50, "notes").when(F.col("n_tokens") >= 1000, "essays").otherwise("articles")
    )


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``n_tokens`` and ``topic``."""
    return without(docs, *ADDED).withColumn("n_tokens", token_count(text)).withColumn("topic", topic(text))


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def token_cells(docs: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Tokens per cell, stored."""
    named = docs.select(*[_key(d).alias(d) for d in dimensions], F.col("n_tokens"))
    return materialise(named.groupBy(*dimensions).agg(F.sum("n_tokens").alias("tokens")), "token_cells")


def tempered_targets(cells: DataFrame, dimension: str, power: float = 0.7) -> DataFrame:
    """``value, target``: shares in proportion to the tokens of each value to a power, which lifts small values."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("raw"))
    return sums.select("value", F.coalesce(F.try_divide(F.col("raw"), scalar(sums, F.sum("raw"))), F.lit(0.0)).alias("target"))


def _scaled(cells: DataFrame, dimension: str) -> DataFrame:
    """Scale the weights so that this dimension's marginal equals its target; ``off`` keeps the largest gap seen."""
    sums = cells.groupBy(dimension).agg(F.sum("weight").alias("_sum"))
    target = F.col(f"_target_{dimension}")
    gap = F.abs(F.col("_sum") - target)
    return cells.join(sums, dimension).withColumn("off", F.greatest("off", gap)).withColumn(
        "weight", F.when(F.col("_sum") > 0, F.col("weight") * target / F.col("_sum")).otherwise(F.lit(0.0))
    ).drop("_sum")


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with tokens plus ``weight``: shares of all tokens with the target marginals. ``targets``: value, target."""
    fitted = cells.filter(F.col("tokens") > 0)
    fitted = fitted.withColumn("weight", F.col("tokens") / scalar(fitted, F.sum("tokens")))
    for d, wanted in targets.items():
        present = fitted.select(F.col(d).alias("value")).distinct().join(wanted.select(F.coalesce("value", F.lit("")).alias("value"), "target"), "value", "left")
        present = present.withColumn("target", F.coalesce("target", F.lit(0.0)))
        present = materialise(present, "targets")
        share = F.coalesce(F.try_divide(F.col("target"), scalar(present, F.sum("target"))), F.lit(0.0))
        shares = present.select(F.col("value").alias(d), share.alias(f"_target_{d}"))
        fitted = fitted.join(shares, d)
    fitted = materialise(fitted, "raked")
    for _ in range(rounds):
        step = fitted.withColumn("off", F.lit(0.0))
        for d in targets:
            step = _scaled(step, d)
        step = materialise(step, "raked")
        off = step.agg(F.max("off")).head()[0]
        fitted = step.drop("off")
        if off is None or off <= tolerance:
            break
    else:
        raise ValueError(f"Raking is off by {off} after {rounds} rounds: the targets cannot all be met by the cells that have tokens.")
    return fitted.drop(*[f"_target_{d}" for d in targets])


def sample_by_weight(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep_tokens: float | None = None, seed: int = 7,
    doc: str = "doc_id", text: str = "text", power: float = 0.7,
) -> DataFrame:
    """``docs`` plus ``topic, n_tokens, probability, sampled`` for every row; without ``targets``, tempered shares.

    ``docs`` is read twice: for the cells and for the draw. It is not shuffled.
    """
    full = described(docs, text)
    cells = token_cells(full)
    targets = targets or {d: tempered_targets(cells, d, power) for d in DIMENSIONS}
    raked = rake(cells, targets)
    per_token = raked.withColumn("_rate", F.col("weight") / F.col("tokens"))
    probability = F.coalesce(F.try_divide(F.col("_rate"), scalar(per_token, F.max("_rate"))), F.lit(0.0))
    rated = per_token.select(*DIMENSIONS, "tokens", probability.alias("_p"))
    if keep_tokens is not None:
        expected = scalar(rated, F.sum(F.col("_p") * F.col("tokens")))
        rated = rated.withColumn("_p", F.col("_p") * F.least(F.lit(1.0), F.try_divide(F.lit(float(keep_tokens)), expected)))
    rated = materialise(rated.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "_p"), "probabilities")
    # The largest cell may hold a third of all documents: the small side is broadcast, or its skewed keys are split.
    # Columns of the input are out of the way in a struct.
    held = full.select(F.struct(*[F.col(f"`{c}`") for c in full.columns]).alias("row"), *[_key(d).alias(f"_{d}") for d in DIMENSIONS])
    joined = held.join(broadcast_if_small(rated, 100_000), [f"_{d}" for d in DIMENSIONS], "left")
    draw = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(f"row.`{doc}`").cast("string"), F.col(f"row.`{text}`")), F.lit(seed)), 11) / F.lit(float(1 << 53))
    probability = F.coalesce("_p", F.lit(0.0))
    return joined.select("row.*", probability.alias("probability"), (draw < probability).alias("sampled"))
