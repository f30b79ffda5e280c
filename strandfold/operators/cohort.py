"""The aligned cohort and the relational operators on it: match, subset, label alignment, unions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_COHORT = "cohort"


@dataclass(frozen=True)
class Cohort:
    """Lazy long tables that share their samples.

    samples(sample_id, cancer), expression(sample_id, gene, value), mutations(sample_id, target, label),
    tmb(sample_id, tmb, tmb_log2). Mutations are sparse: a sample without a row for a target is 0, unless
    it has no label rows at all and ``labelled`` says otherwise.
    """

    samples: DataFrame
    expression: DataFrame
    mutations: DataFrame | None = None
    tmb: DataFrame | None = None

    @classmethod
    def from_tables(
        cls, expression: DataFrame, mutations: DataFrame | None = None, tmb: DataFrame | None = None, cancer: DataFrame | None = None
    ) -> Cohort:
        """Everything is aligned to the expression samples; without labels all belong to one cohort."""
        ids = expression.select("sample_id").distinct()
        if cancer is None:
            samples = ids.withColumn("cancer", F.lit(DEFAULT_COHORT))
        else:
            samples = align_labels(ids, cancer.select("sample_id", "cancer"))
        return cls(samples, expression, _restrict(mutations, samples), _restrict(tmb, samples))

    @classmethod
    def from_files(cls, spark, cancers, **settings) -> Cohort:
        """Read, clean, match and union cohort files; see :func:`strandfold.plans.prepare.prepare_cohorts`."""
        from ..plans.prepare import prepare_cohorts

        return prepare_cohorts(spark, cancers, **settings)

    @property
    def genes(self) -> DataFrame:
        return self.expression.select("gene").distinct()

    @property
    def targets(self) -> DataFrame | None:
        return None if self.mutations is None else self.mutations.select("target").distinct()

    def subset(self, samples: DataFrame | Iterable[str] | None = None, targets: Sequence[str] | None = None) -> Cohort:
        """Keep the given samples (unknown ones are ignored) and targets (unknown ones are an error)."""
        result = self
        if samples is not None:
            if not isinstance(samples, DataFrame):
                samples = self.samples.sparkSession.createDataFrame([(s,) for s in samples], "sample_id string")
            result = Cohort(
                *[_restrict(t, samples) for t in (self.samples, self.expression, self.mutations, self.tmb)]
            )
        if targets is not None and self.mutations is not None:
            wanted = list(targets)
            found = {r["target"] for r in self.targets.filter(F.col("target").isin(wanted)).collect()}
            if set(wanted) - found:
                raise ValueError(f"Unknown targets: {sorted(set(wanted) - found)}")
            result = replace(result, mutations=result.mutations.filter(F.col("target").isin(wanted)))
        return result

    def without(self, samples: DataFrame) -> Cohort:
        """The hold-out complement of ``subset(samples)``."""
        return Cohort(
            *[
                None if t is None else t.join(samples.select("sample_id"), "sample_id", "left_anti")
                for t in (self.samples, self.expression, self.mutations, self.tmb)
            ]
        )

    def summary(self) -> DataFrame:
        return cohort_summary(self)


def _restrict(table: DataFrame | None, samples: DataFrame) -> DataFrame | None:
    return None if table is None else table.join(samples.select("sample_id"), "sample_id", "left_semi")


def scalar(df: DataFrame, aggregate: Column) -> Column:
    """A one-value aggregate of ``df`` as a scalar subquery."""
    return df.agg(aggregate).scalar()


def cohort_summary(cohort: Cohort) -> DataFrame:
    """One row: distinct samples, features, targets, and the sorted cohort list (missing labels skipped)."""
    targets = F.lit(0).cast("bigint") if cohort.mutations is None else scalar(cohort.mutations, F.countDistinct("target"))
    cancers = cohort.samples.agg(
        F.countDistinct("sample_id").alias("n_samples"), F.array_sort(F.collect_set("cancer")).alias("cancers")
    )
    return cancers.select(
        "n_samples",
        scalar(cohort.expression, F.countDistinct("gene")).alias("n_features"),
        targets.alias("n_targets"),
        "cancers",
    )


def match_samples(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct sample ids present in both tables."""
    return left.select("sample_id").distinct().join(right.select("sample_id").distinct(), "sample_id", "left_semi")


def align_labels(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels in the order of the samples' ids: unlabelled samples stay, with NULL."""
    return samples.join(labels, "sample_id", "left")


def restrict_targets(mutations: DataFrame, annotation: DataFrame) -> DataFrame:
    """Targets that are symbols of protein-coding genes."""
    coding = annotation.filter(F.col("biotype") == "protein_coding").select(F.col("symbol").alias("target"))
    return mutations.join(coding, "target", "left_semi")


def shared_genes(expression: DataFrame, cohorts: int | Column) -> DataFrame:
    """Genes seen in all cohorts. ``expression`` has a ``cancer`` column."""
    seen = expression.groupBy("gene").agg(F.countDistinct("cancer").alias("n_cohorts"))
    return seen.filter(F.col("n_cohorts") == cohorts).select("gene")


def union_shared_genes(expressions: dict[str, DataFrame]) -> DataFrame:
    """Stack per-cohort expression, keeping the genes that every cohort has.

    The gene lists (not the cells) decide, so the extra pass shuffles one row per cohort and gene.
    """
    tagged = [df.withColumn("cancer", F.lit(name)) for name, df in expressions.items()]
    stacked = reduce(DataFrame.unionByName, tagged)
    lists = reduce(DataFrame.unionByName, [t.select("gene", "cancer").distinct() for t in tagged])
    return stacked.join(shared_genes(lists, F.lit(len(tagged))), "gene", "left_semi")


def union_all_targets(mutations: dict[str, DataFrame]) -> DataFrame:
    """Stack per-cohort labels. In sparse form the zeros of absent targets need no rows."""
    return reduce(DataFrame.unionByName, [df.withColumn("cancer", F.lit(name)) for name, df in mutations.items()])


def explicit_labels(mutations: DataFrame, samples: DataFrame, targets: list[str]) -> DataFrame:
    """Every (sample, target) with 0 where no call exists."""
    from .align import dense_rows, long_rows, with_index

    positive = mutations.groupBy("sample_id", "target").agg(F.max("label").alias("value"))
    rows = dense_rows(with_index(positive, targets, "target"), samples, len(targets), 0.0, "labels")
    return long_rows(rows, targets, "labels", "target", "label").withColumn("label", F.col("label").cast("int"))


def tagged_union(tables: dict[str, DataFrame], tag: str = "input") -> DataFrame:
    """Stack result tables under a key column."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in tables.items()])


def require_unique_samples(samples: DataFrame) -> None:
    """A sample that belongs to two cohorts has no single row to align to."""
    repeated = samples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).limit(5).collect()
    if repeated:
        raise ValueError(f"Sample ids occur in more than one cohort: {[r['sample_id'] for r in repeated]}")
