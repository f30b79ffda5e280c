"""Partial states: any cut of the data merges to what one pass says."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandfold.operators import summaries as su
from strandfold.operators.align import feature_stats
from strandfold.operators.targets import prevalence


def cells(spark):
    rng = np.random.default_rng(21)
    rows = [(f"s{i}", f"g{j}", None if (i * j) % 13 == 5 else float(rng.normal() * 10**j + 1e6), f"c{i % 4}" if i % 9 else None) for i in range(80) for j in range(5)]
    rows += [("s1", "flat", 2.5, "c1"), ("s2", "flat", 2.5, "c2"), ("s3", "empty", None, "c3"), ("s3", "empty", float("nan"), "c3"), ("s4", "g0", float("inf"), "c0")]
    return spark.createDataFrame(rows, "sample_id string, gene string, value double, cohort string")


def close(got, want):
    assert got.keys() == want.keys()
    for gene, row in want.items():
        for a, b in zip(got[gene], row, strict=True):
            assert a == b if a is None or b is None else a == pytest.approx(b, rel=1e-8)


@pytest.mark.parametrize("pieces", [1, 3, 40])
def test_any_cut_merges_to_one_pass(spark, pieces):
    x = cells(spark)
    finite = x.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    want = {r["gene"]: (r["mean"], r["std"], r["scale"]) for r in feature_stats(finite).collect()}
    cut = x.withColumn("piece", F.pmod(F.crc32(F.concat("sample_id", "gene")), F.lit(pieces)).cast("string"))
    found = su.stats_from_states(su.gene_states(cut, "piece")).collect()
    got = {r["gene"]: (r["mean"], r["std"], r["scale"]) for r in found if r["gene"] != "empty"}
    close(got, want)
    empty = next(r for r in found if r["gene"] == "empty")
    assert (empty["n"], empty["parts"], empty["mean"], empty["scale"]) == (0, 0, None, 1.0)


def test_merged_states_merge_again(spark):
    states = su.gene_states(cells(spark), "cohort").withColumn("half", F.crc32("part") % 2)
    halves = su.merge_genes(states, "half").drop("parts")
    one, two = su.merge_genes(states).drop("parts"), su.merge_genes(halves).drop("parts")
    close({r["gene"]: tuple(r)[1:] for r in two.collect()}, {r["gene"]: tuple(r)[1:] for r in one.collect()})


def test_cohorts_are_added_one_by_one(spark, tmp_path):
    x = cells(spark).filter("cohort IS NOT NULL")
    samples = x.select("sample_id", "cohort").distinct()
    calls = samples.select("sample_id", F.lit("T").alias("target"), (F.crc32("sample_id") % 3 == 0).cast("int").alias("label"))
    table = su.StateTable(spark, str(tmp_path / "states"))
    for c in ("c0", "c1", "c2", "c3"):
        own = samples.filter(F.col("cohort") == c)
        table.add(c, x.filter(F.col("cohort") == c), calls.join(own, "sample_id", "left_semi"), own)
    one = su.stats_from_states(su.gene_states(x))
    close({r["gene"]: (r["n"], r["mean"], r["std"]) for r in table.feature_stats().collect()}, {r["gene"]: (r["n"], r["mean"], r["std"]) for r in one.collect()})
    assert table.prevalence().collect() == prevalence(calls, samples).collect()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        table.add("c0", x.filter("cohort = 'c0'"))
