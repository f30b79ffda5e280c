import math

import pytest
from pyspark.sql import functions as F

from strandfold.functions.identifiers import (
    canonical_sample_id,
    cohort_code_list,
    cohort_codes,
    probe_symbol,
    quoted_attribute,
    split_attribute,
    strip_version,
)
from strandfold.functions.significance import correlation_p_value, incomplete_beta
from strandfold.functions.values import burden_from_log2, burden_log2, is_finite, is_mutated, number, transform_expression


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_canonical_sample_id(spark):
    raw = ["TCGA-AB-1234-01", "TCGA-AB-1234-01A-01R", "TCGA-AB-1234", "X-AB-1234-01", "TCGA-AB-1234-1", "TCGA-A-B-01AB", "", None]
    assert column(spark, raw, "string", canonical_sample_id) == [
        "TCGA-AB-1234-01A", "TCGA-AB-1234-01A", "TCGA-AB-1234", "X-AB-1234-01", "TCGA-AB-1234-1", "TCGA-A-B-01A", "", None,
    ]


def test_strip_version_and_codes(spark):
    assert column(spark, ["ENSG1.12", "ENSG1", "A.b.c"], "string", strip_version) == ["ENSG1", "ENSG1", "A"]
    assert column(spark, [" luad, BRCA ,,luad"], "string", cohort_codes) == [["LUAD", "BRCA"]]
    assert cohort_code_list(["luad,brca", " LUAD "]) == ["LUAD", "BRCA"]
    for empty in (None, [], [" , "]):
        with pytest.raises(ValueError):
            cohort_code_list(empty)


def test_probe_symbol(spark):
    raw = ["EGFR /// KRAS", " TP53 ", "---", "", "nan", "--- /// EGFR"]
    assert column(spark, raw, "string", probe_symbol) == ["EGFR", "TP53", None, None, None, None]


def test_attributes(spark):
    text = 'gene_id "ENSG1.1"; gene_name "A"; gene_type "";'
    assert column(spark, [text], "string", lambda c: quoted_attribute(c, "gene_id")) == ["ENSG1.1"]
    assert column(spark, [text], "string", lambda c: quoted_attribute(c, "gene_biotype")) == [None]
    pairs = column(spark, ["status : EGFR mutation + ", "a: b: c", "lonely"], "string", split_attribute)
    assert [tuple(p) for p in pairs] == [("status", "EGFR mutation +"), ("a", "b: c"), ("lonely", "")]


def test_transforms(spark):
    values = [0.0, 2.0, None]

    def run(mode, offset=1.0):
        return column(spark, values, "double", lambda c: transform_expression(c, mode, offset))

    assert run("log1p")[:2] == pytest.approx([0.0, math.log1p(3.0)])
    assert run("log1p", 0.5)[:2] == pytest.approx([math.log1p(0.5), math.log1p(3.5)])
    assert run("raw")[:2] == pytest.approx([0.0, 3.0])
    assert run("xena") == values
    assert run("log1p")[2] is None and run("raw")[2] is None
    assert column(spark, [-3.0], "double", lambda c: transform_expression(c, "raw")) == [0.0]
    with pytest.raises(ValueError):
        transform_expression(F.col("x"), "cube")


def test_numbers_and_calls(spark):
    raw = ["1.5", " 2 ", "abc", "NaN", "", None]
    assert column(spark, raw, "string", number) == [1.5, 2.0, None, None, None, None]
    assert column(spark, [2.0, 0.0, -1.0, float("nan"), None], "double", is_mutated) == [1, 0, 0, 0, 0]
    finite = column(spark, [1.0, float("nan"), float("inf"), None], "double", is_finite)
    assert [bool(f) for f in finite] == [True, False, False, False]


def test_burden_scale(spark):
    assert column(spark, [0, 7], "bigint", burden_log2) == [0.0, 3.0]
    assert column(spark, [3.0, -1.0, None], "double", burden_from_log2) == [7.0, 0.0, None]
    assert column(spark, [-1.0], "double", lambda c: burden_from_log2(c, clip=False)) == [-0.5]


def test_incomplete_beta_closed_forms():
    # I_x(1, b) = 1 - (1 - x)^b and I_x(a, 1) = x^a
    for x in (0.01, 0.3, 0.5, 0.9, 0.999):
        assert incomplete_beta(1.0, 3.5, x) == pytest.approx(1 - (1 - x) ** 3.5, abs=1e-12)
        assert incomplete_beta(2.5, 1.0, x) == pytest.approx(x**2.5, abs=1e-12)
    assert incomplete_beta(2.0, 2.0, 0.0) == 0.0 and incomplete_beta(2.0, 2.0, 1.0) == 1.0


def test_correlation_p_value(spark):
    df = spark.createDataFrame([(1.0, 10), (0.0, 10), (0.5, 3), (0.5, 4), (None, 10), (0.9, 2)], "r double, n bigint")
    got = [r["p"] for r in df.select(correlation_p_value("r", "n").alias("p")).collect()]
    # One degree of freedom is Cauchy: P(|T| > t) = 1 - 2 atan(t) / pi; two degrees: 1 - t / sqrt(t^2 + 2).
    t1, t2 = 0.5 / math.sqrt(0.75), 0.5 * math.sqrt(2 / 0.75)
    want = [0.0, 1.0, 1 - 2 * math.atan(t1) / math.pi, 1 - t2 / math.sqrt(t2 * t2 + 2)]
    assert got[:4] == pytest.approx(want, abs=1e-12)
    assert [g is None or math.isnan(g) for g in got[4:]] == [True, True]
