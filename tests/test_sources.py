import gzip

import pytest
from pyspark.sql import functions as F

from strandfold import Cohort
from strandfold.operators.cohort import (
    cohort_summary, explicit_labels, require_unique_samples, tagged_union, union_all_targets, union_shared_genes,
)
from strandfold.operators.collapse import burden_counts, collapse, probes_to_genes
from strandfold.operators.targets import class_weights, prevalence, select_targets, status_labels
from strandfold.sources.annotation import read_annotation
from strandfold.sources.cache import prepared_path, read_prepared, settings_digest
from strandfold.sources.events import preferred_column, read_events
from strandfold.sources.export import export_cohort, read_metadata, write_bundle, write_wide
from strandfold.sources.matrix import read_expression, read_matrix, read_mutations, read_scoring_matrix

A, B = "TCGA-AB-0001-01A", "TCGA-AB-0002-01A"
GTF = (
    "##description: made by hand\n"
    'chr1\tt\tgene\t1\t2\t.\t+\t.\tgene_id "ENSG1.1"; gene_name "A"; gene_type "protein_coding";\n'
    'chr1\tt\texon\t1\t2\t.\t+\t.\tgene_id "ENSG9.1"; gene_name "Z"; gene_type "protein_coding";\n'
    'chr1\tt\tgene\t3\t4\t.\t+\t.\tgene_id "ENSG2.1"; gene_name "A"; gene_biotype "protein_coding";\n'
    'chr1\tt\tgene\t5\t6\t.\t+\t.\tgene_id "ENSG3.1"; gene_name "B"; gene_type "lncRNA";\n'
    'chr1\tt\tgene\t5\t6\t.\t+\t.\tgene_id "ENSG3.2"; gene_name "C"; gene_type "lncRNA";\n'
    'chr1\tt\tgene\t5\t6\t.\t+\t.\tgene_name "NOID"; gene_type "lncRNA";\n'
    "chr1\tt\tgene\ttoo short\n"
)


def zipped(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt", encoding="utf-8") as handle:
        handle.write(text)
    return str(path)


@pytest.fixture()
def files(tmp_path):
    zipped(tmp_path / "e" / "LUAD.tsv.gz", f"id\t{A}\t{B}\nENSG1.1\t3\t0\nENSG2.1\t0\t4\nENSG3.1\t1\t2\n")
    zipped(tmp_path / "m" / "LUAD.tsv.gz", "gene\tTCGA-AB-0001-01\tTCGA-AB-0002-01\nTP53\t1\t0\nKRAS\t0\t1\n")
    zipped(tmp_path / "g" / "annotation.gtf.gz", GTF)
    events = "sample\teffect\n" + f"{A}\tMissense_Mutation\n{A}\tSilent\n{A}\tSplice_Site\nTCGA-AB-0002-01\tIn_Frame_Del\n"
    zipped(tmp_path / "v" / "LUAD.tsv.gz", events)
    return tmp_path


def paths(root, **more):
    return {
        "expression_path": f"{root}/e/{{cancer}}.tsv.gz",
        "annotation_path": f"{root}/g/annotation.gtf.gz",
        "mutation_path": f"{root}/m/{{cancer}}.tsv.gz",
        "transform": "raw", "min_prevalence": 0.5, "protein_coding_targets": False,
        **more,
    }


def test_annotation(spark, files):
    rows = sorted(map(tuple, read_annotation(spark, f"{files}/g/annotation.gtf.gz").collect()))
    assert rows == [("ENSG1", "A", "protein_coding"), ("ENSG2", "A", "protein_coding"), ("ENSG3", "B", "lncRNA")]


def test_files_to_cohort(spark, files):
    data = Cohort.from_files(spark, ["luad"], **paths(files))
    cells = {(r["sample_id"], r["gene"]): r["value"] for r in data.expression.collect()}
    assert cells == {(A, "A"): pytest.approx(3.5), (B, "A"): pytest.approx(7.5)}
    assert {r["target"] for r in data.targets.collect()} == {"TP53", "KRAS"}
    summary = data.summary().first()
    assert (summary["n_samples"], summary["n_features"], summary["n_targets"], summary["cancers"]) == (2, 1, 2, ["LUAD"])


def test_burden_is_attached(spark, files):
    data = Cohort.from_files(spark, ["LUAD"], **paths(files, event_path=f"{files}/v/{{cancer}}.tsv.gz"))
    assert {r["sample_id"]: r["tmb"] for r in data.tmb.collect()} == {A: 2, B: 1}
    events_only = paths(files, event_path=f"{files}/v/{{cancer}}.tsv.gz", mutation_path=None)
    data = Cohort.from_files(spark, ["LUAD"], **events_only)
    assert data.samples.count() == 2 and data.mutations is None


def test_coding_targets_and_empty_selection(spark, files):
    with pytest.raises(ValueError, match="prevalence"):
        Cohort.from_files(spark, ["LUAD"], **paths(files, protein_coding_targets=True))
    with pytest.raises(ValueError, match="prevalence"):
        Cohort.from_files(spark, ["LUAD"], **paths(files, min_prevalence=0.9))
    with pytest.raises(ValueError, match="Unknown settings"):
        Cohort.from_files(spark, ["LUAD"], **paths(files, typo=1))


def test_unmatched_cohort_is_an_error(spark, files):
    zipped(files / "m" / "LUAD.tsv.gz", "gene\tTCGA-ZZ-0001-01\nTP53\t1\n")
    with pytest.raises(ValueError, match="No matched"):
        Cohort.from_files(spark, ["LUAD"], **paths(files))


def test_two_cohorts_share_genes_and_pool_targets(spark, files):
    c, d = "TCGA-CD-0003-01A", "TCGA-CD-0004-01A"
    zipped(files / "e" / "BRCA.tsv.gz", f"id\t{c}\t{d}\nENSG1.1\t1\t1\n")
    zipped(files / "m" / "BRCA.tsv.gz", f"s\tEGFR\n{c}\t1\n{d}\t1\n")
    data = Cohort.from_files(spark, ["LUAD,BRCA"], **paths(files, protein_coding_only=False, min_prevalence=0.25))
    assert {r["gene"] for r in data.genes.collect()} == {"A"}
    shares = {r["target"]: r["prevalence"] for r in prevalence(data.mutations, data.samples).collect()}
    assert shares == {"TP53": 0.25, "KRAS": 0.25, "EGFR": 0.5}
    assert [r["cancer"] for r in data.samples.orderBy("sample_id").collect()] == ["LUAD", "LUAD", "BRCA", "BRCA"]


def test_cache_is_reused_and_keyed_by_settings(spark, files, tmp_path):
    cache = str(tmp_path / "cache")
    first = Cohort.from_files(spark, ["LUAD"], **paths(files, cache_dir=cache))
    rows = sorted(map(tuple, first.expression.collect()))
    zipped(files / "e" / "LUAD.tsv.gz", f"id\t{A}\t{B}\nENSG1.1\t9\t9\n")
    again = Cohort.from_files(spark, ["LUAD"], **paths(files, cache_dir=cache))
    assert sorted(map(tuple, again.expression.collect())) == rows
    changed = Cohort.from_files(spark, ["LUAD"], **paths(files, cache_dir=cache, collapse="sum"))
    assert sorted(map(tuple, changed.expression.collect())) != rows
    assert settings_digest({"a": 1, "b": 2}) == settings_digest({"b": 2, "a": 1}) and len(settings_digest({})) == 16
    assert read_prepared(spark, prepared_path(cache, {"never": "written"})) is None


def test_matrix_reader_edges(spark, tmp_path):
    path = zipped(tmp_path / "x.tsv.gz", f"id\t{A}\tTCGA-AB-0001-01\t{B}\ng1\t1\t7\t\ng2\tbad\t8\t3\n\n")
    cells = {(r["sample_id"], r["gene_id"]): r["value"] for r in read_expression(spark, path).collect()}
    assert cells == {(A, "g1"): 1.0, (A, "g2"): None, (B, "g1"): None, (B, "g2"): 3.0}


def test_matrix_reader_takes_one_header_per_file(spark, tmp_path):
    zipped(tmp_path / "many" / "a.tsv.gz", "id\tx\ty\nr1\t1\t2\n")
    zipped(tmp_path / "many" / "b.tsv.gz", "id\ty\tz\nr2\t3\t4\n")
    cells = {(r["row_id"], r["column_id"]): r["value"] for r in read_matrix(spark, str(tmp_path / "many")).collect()}
    assert cells == {("r1", "x"): 1.0, ("r1", "y"): 2.0, ("r2", "y"): 3.0, ("r2", "z"): 4.0}


@pytest.mark.parametrize("text", [f"g\t{A}\t{B}\nTP53\t1\t0\nKRAS\t0\t1\n", f"s\tTP53\tKRAS\n{A}\t1\t0\n{B}\t0\t1\n"])
def test_mutation_reader_finds_the_orientation(spark, tmp_path, text):
    cells = read_mutations(spark, zipped(tmp_path / "m.tsv.gz", text)).collect()
    assert {(r["sample_id"], r["target"]): r["value"] for r in cells} == {
        (A, "TP53"): 1.0, (A, "KRAS"): 0.0, (B, "TP53"): 0.0, (B, "KRAS"): 1.0,
    }


def test_scoring_matrix_rejects_repeats(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("sample,A,B\ns1,1,2\ns2,,x\n")
    cells = {(r["sample_id"], r["gene"]): r["value"] for r in read_scoring_matrix(spark, str(good)).collect()}
    assert cells == {("s1", "A"): 1.0, ("s1", "B"): 2.0, ("s2", "A"): None, ("s2", "B"): None}
    bad = tmp_path / "bad.csv"
    bad.write_text("sample,A\ns1,1\ns1,2\n")
    with pytest.raises(ValueError, match="unique"):
        read_scoring_matrix(spark, str(bad))


def test_event_columns(spark, tmp_path):
    assert preferred_column(["effect", "Variant_Classification"], ("effect", "Variant_Classification")) == "effect"
    path = tmp_path / "ev.tsv"
    path.write_text("Tumor_Sample_Barcode\tVariant_Classification\tx\nTCGA-AB-1-01\tSilent\t1\nTCGA-AB-1-01\tSplice_Site\t1\n")
    assert [tuple(r) for r in burden_counts(read_events(spark, str(path))).collect()] == [("TCGA-AB-1-01A", 1, 1.0)]
    path.write_text("sample\tother\na\tb\n")
    with pytest.raises(ValueError, match="Missing"):
        read_events(spark, str(path))
    path.write_text("sample\teffect\n")
    assert burden_counts(read_events(spark, str(path))).count() == 0


def test_collapse_modes(spark):
    rows = [("s", "A", None, 0), ("s", "A", 3.0, 1), ("s", "A", 5.0, 2), ("s", "B", None, 3)]
    df = spark.createDataFrame(rows, "sample_id string, gene string, value double, gene_pos int")

    def run(how):
        return {r["gene"]: r["value"] for r in collapse(df, how).collect()}

    assert run("mean") == {"A": 4.0, "B": None}
    assert run("sum") == {"A": 8.0, "B": 0.0}
    assert run("first") == {"A": None, "B": None}
    with pytest.raises(ValueError):
        collapse(df, "median")


def test_probes_and_status(spark):
    cells = spark.createDataFrame([("s", "p1", 1.0), ("s", "p2", 3.0), ("s", "p3", 9.0)], "sample_id string, probe string, value double")
    platform = spark.createDataFrame([("p1", "A /// B"), ("p2", "A"), ("p3", "---")], "probe string, symbols string")
    assert [tuple(r) for r in probes_to_genes(cells, platform).collect()] == [("s", "A", 2.0)]
    stated = spark.createDataFrame(
        [("s1", ["status: EGFR mutation +"]), ("s2", ["status: KRAS mutation +", "age: 4"]), ("s3", ["age: 3"])],
        "sample_id string, attributes array<string>",
    )
    labels = status_labels(stated, "status", {"EGFR": "EGFR mutation +", "KRAS": "KRAS mutation +"})
    assert {(r["sample_id"], r["target"]): r["label"] for r in labels.collect()} == {
        ("s1", "EGFR"): 1, ("s1", "KRAS"): 0, ("s2", "EGFR"): 0, ("s2", "KRAS"): 1,
    }


def test_unions(spark):
    one = spark.createDataFrame([("a", "G1", 1.0), ("a", "G2", 2.0)], "sample_id string, gene string, value double")
    two = spark.createDataFrame([("b", "G2", 3.0), ("b", "G3", 4.0)], "sample_id string, gene string, value double")
    rows = union_shared_genes({"X": one, "Y": two}).select("sample_id", "gene", "value", "cancer").collect()
    assert sorted(map(tuple, rows)) == [("a", "G2", 2.0, "X"), ("b", "G2", 3.0, "Y")]
    calls = union_all_targets({
        "X": spark.createDataFrame([("a", "T1", 1)], "sample_id string, target string, label int"),
        "Y": spark.createDataFrame([("b", "T2", 1)], "sample_id string, target string, label int"),
    })
    ids = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    full = {(r["sample_id"], r["target"]): r["label"] for r in explicit_labels(calls, ids, ["T1", "T2"]).collect()}
    assert full == {("a", "T1"): 1, ("a", "T2"): 0, ("b", "T1"): 0, ("b", "T2"): 1}
    assert {r["input"] for r in tagged_union({"p": one, "q": two}).collect()} == {"p", "q"}
    with pytest.raises(ValueError, match="more than one cohort"):
        require_unique_samples(spark.createDataFrame([("a",), ("a",)], "sample_id string"))


def test_subset_and_summary(spark):
    cells = spark.createDataFrame([(f"s{i}", g, 1.0) for i in range(4) for g in "AB"], "sample_id string, gene string, value double")
    calls = spark.createDataFrame([("s0", "T1", 1), ("s1", "T2", 1)], "sample_id string, target string, label int")
    data = Cohort.from_tables(cells, calls)
    assert {r["cancer"] for r in data.samples.collect()} == {"cohort"}
    part = data.subset(samples=["s0", "s1", "unknown"], targets=["T1"])
    assert part.samples.count() == 2 and part.expression.count() == 4
    assert [r["target"] for r in part.mutations.collect()] == ["T1"]
    with pytest.raises(ValueError, match="Unknown targets"):
        data.subset(targets=["T9"])
    rest = data.without(part.samples)
    assert {r["sample_id"] for r in rest.samples.collect()} == {"s2", "s3"}
    assert cohort_summary(rest).first()["n_features"] == 2


def test_target_selection_and_weights(spark):
    ids = spark.createDataFrame([(f"s{i}",) for i in range(10)], "sample_id string")
    rows = [(f"s{i}", t, 1) for t, n in {"B": 4, "A": 4, "C": 1, "ALL": 10}.items() for i in range(n)]
    calls = spark.createDataFrame(rows + [("s0", "NONE", 0)], "sample_id string, target string, label int")
    assert [r["target"] for r in select_targets(calls, ids, 0.2, 2).collect()] == ["ALL", "A"]
    assert [r["target"] for r in select_targets(calls, ids, 0.05, None).collect()] == ["ALL", "A", "B", "C"]
    weights = {r["target"]: r for r in class_weights(calls, ids).collect()}
    assert weights["C"]["pos_weight"] == 9.0 and weights["ALL"]["pos_weight"] == 1.0 and weights["NONE"]["pos_weight"] == 1.0
    assert weights["NONE"]["tree_scale"] == 10.0 and weights["A"]["balanced_positive"] == 1.25
    assert weights["ALL"]["balanced_negative"] == 5.0


def test_exports(spark, tmp_path):
    cells = spark.createDataFrame([("s1", "A", 1.5), ("s1", "B", None), ("s2", "B", 2.0)], "sample_id string, gene string, value double")
    ids = spark.createDataFrame([("s1",), ("s2",)], "sample_id string")
    path = str(tmp_path / "wide")
    write_wide(cells, ids, ["A", "B"], path)
    back = {(r["sample_id"], r["gene"]): r["value"] for r in read_scoring_matrix(spark, path).collect()}
    assert back == {("s1", "A"): 1.5, ("s1", "B"): None, ("s2", "A"): None, ("s2", "B"): 2.0}
    where = write_bundle(spark, str(tmp_path / "bundle"), {"cells": cells}, {"k": [1, "x"]})
    assert read_metadata(spark, where) == {"k": [1, "x"]}
    assert spark.read.parquet(f"{where}/cells").count() == 3
    with pytest.raises(Exception):
        write_bundle(spark, where, {"cells": cells}, {})


def test_cohort_export(spark, tmp_path):
    cells = spark.createDataFrame([("s1", "A", 1.5), ("s2", "B", 2.0)], "sample_id string, gene string, value double")
    calls = spark.createDataFrame([("s1", "T", 1)], "sample_id string, target string, label int")
    data = Cohort.from_tables(cells, calls)
    assert export_cohort(data, str(tmp_path / "wide"))["n_targets"] == 1
    back = read_scoring_matrix(spark, str(tmp_path / "wide" / "mutations"))
    assert sorted(map(tuple, back.collect())) == [("s1", "T", 1.0), ("s2", "T", 0.0)]
    back = read_scoring_matrix(spark, str(tmp_path / "wide" / "expression")).filter("value is not null")
    assert sorted(map(tuple, back.collect())) == [("s1", "A", 1.5), ("s2", "B", 2.0)]
    export_cohort(data, str(tmp_path / "long"), wide=False)
    assert spark.read.parquet(str(tmp_path / "long" / "expression")).count() == 2
