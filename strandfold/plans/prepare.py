"""From cohort files to an aligned cohort: read, clean, match, union, select."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import cohort_code_list
from ..functions.values import is_mutated, transform_expression
from ..operators.cohort import (
    Cohort,
    match_samples,
    require_unique_samples,
    restrict_targets,
    union_all_targets,
    union_shared_genes,
)
from ..operators.collapse import annotate, burden_counts, collapse
from ..operators.targets import keep_selected
from ..session import materialise
from ..sources.annotation import read_annotation
from ..sources.cache import cached_cohort
from ..sources.events import read_events
from ..sources.matrix import read_expression, read_mutations

# Default settings of a preparation.
DEFAULTS = {
    "transform": "log1p",
    "offset": 1.0,
    "protein_coding_only": True,
    "protein_coding_targets": True,
    "collapse": "mean",
    "min_prevalence": 0.05,
    "max_targets": None,
}


def clean_expression(cells: DataFrame, annotation: DataFrame, settings: Mapping) -> DataFrame:
    """Transform, name and collapse raw cells: ``sample_id, gene, value``."""
    values = cells.withColumn("value", transform_expression(F.col("value"), settings["transform"], settings["offset"]))
    return collapse(annotate(values, annotation, settings["protein_coding_only"]), settings["collapse"], "gene_id_pos")


def clean_mutations(cells: DataFrame, annotation: DataFrame, settings: Mapping) -> DataFrame:
    """Binary calls: ``sample_id, target, label``. Zero rows stay, for they say which samples were assayed."""
    calls = cells.select("sample_id", "target", is_mutated(F.col("value")).alias("label"))
    return restrict_targets(calls, annotation) if settings["protein_coding_targets"] else calls


def combine(parts: Mapping[str, tuple[DataFrame, DataFrame, DataFrame | None]], settings: Mapping) -> Cohort:
    """Match samples inside each cohort, stack the cohorts, select targets.

    ``parts``: cohort -> (expression, mutations, assayed samples of the mutation file).
    """
    samples, expression, mutations = [], {}, {}
    for cancer, (cells, calls, assayed) in parts.items():
        matched = match_samples(cells, calls if assayed is None else assayed)
        if matched.limit(1).count() == 0:
            raise ValueError(f"No matched samples: {cancer} has none in both its expression and its mutations.")
        samples.append(matched.withColumn("cancer", F.lit(cancer)))
        expression[cancer] = cells.join(matched, "sample_id", "left_semi")
        mutations[cancer] = calls.join(matched, "sample_id", "left_semi")
    everyone = reduce(DataFrame.unionByName, samples)
    require_unique_samples(everyone)
    labels = union_all_targets(mutations).drop("cancer")
    chosen = keep_selected(labels, everyone, settings["min_prevalence"], settings["max_targets"])
    if chosen.limit(1).count() == 0:
        raise ValueError("Every target is below the wanted prevalence.")
    return Cohort(everyone, union_shared_genes(expression).drop("cancer"), chosen)


def combine_burden(parts: Mapping[str, tuple[DataFrame, DataFrame]]) -> Cohort:
    """Cohort with burden labels. ``parts``: cohort -> (expression, burden)."""
    samples, expression, burden = [], {}, []
    for cancer, (cells, counts) in parts.items():
        matched = match_samples(cells, counts)
        samples.append(matched.withColumn("cancer", F.lit(cancer)))
        expression[cancer] = cells.join(matched, "sample_id", "left_semi")
        burden.append(counts.join(matched, "sample_id", "left_semi"))
    everyone = reduce(DataFrame.unionByName, samples)
    if everyone.limit(1).count() == 0:
        raise ValueError("No matched samples: none has both expression and coding events.")
    require_unique_samples(everyone)
    return Cohort(everyone, union_shared_genes(expression).drop("cancer"), tmb=reduce(DataFrame.unionByName, burden))


def prepare_cohorts(
    spark: SparkSession,
    cancers: Iterable[str],
    expression_path: str,
    annotation_path: str,
    mutation_path: str | None = None,
    event_path: str | None = None,
    cache_dir: str | None = None,
    **overrides,
) -> Cohort:
    """Paths may hold ``{cancer}``. With mutations the cohort is matched on them and burden is attached;
    with events alone it is matched on burden. ``cache_dir`` stores the result under its settings."""
    unknown = set(overrides) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"Unknown settings: {sorted(unknown)}")
    if mutation_path is None and event_path is None:
        raise ValueError("Give mutation_path, event_path or both.")
    settings = {**DEFAULTS, **overrides}
    codes = cohort_code_list(cancers)

    def build() -> Cohort:
        # Each source is read once and stored: matching, gene sharing and selection all come back to it, and
        # the annotation is then broadcast on its true size.
        annotation = materialise(read_annotation(spark, annotation_path), "annotation")
        expression = {
            c: materialise(
                clean_expression(read_expression(spark, expression_path.format(cancer=c)), annotation, settings), f"expression_{c}"
            )
            for c in codes
        }
        burden = {c: burden_counts(read_events(spark, event_path.format(cancer=c))) for c in codes} if event_path else {}
        if mutation_path is None:
            return combine_burden({c: (expression[c], burden[c]) for c in codes})
        parts = {}
        for c in codes:
            cells = materialise(read_mutations(spark, mutation_path.format(cancer=c)), f"mutations_{c}")
            parts[c] = (expression[c], clean_mutations(cells, annotation, settings), cells.select("sample_id").distinct())
        cohort = combine(parts, settings)
        if not burden:
            return cohort
        counts = reduce(DataFrame.unionByName, [
            b.join(cohort.samples.filter(F.col("cancer") == c), "sample_id", "left_semi") for c, b in burden.items()
        ])
        return Cohort(cohort.samples, cohort.expression, cohort.mutations, counts)

    if cache_dir is None:
        return build()
    sources = {"annotation": annotation_path, "expression": expression_path, "mutations": mutation_path, "events": event_path}
    return cached_cohort(spark, cache_dir, {"cancers": codes, **settings, **sources}, build)
