"""Queries over sources, identifiers, values, collapse and cohort operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.identifiers import canonical_sample_id, cohort_codes, probe_symbol, strip_version
from ..functions.values import burden_from_log2, is_mutated, number, transform_expression
from ..operators import cohort as co
from ..operators.collapse import annotate, burden_counts, collapse, probes_to_genes
from ..operators.dedupe import keep_first
from ..operators.targets import status_labels
from ..session import materialise, scratch_path
from ..sources.annotation import annotation_from_attributes, read_annotation
from ..sources.cache import cached_cohort
from ..sources.events import read_events, resolve_events
from ..sources.export import pivot_wide, write_wide
from ..sources.matrix import duplicate_samples, read_matrix, read_mutations, read_scoring_matrix, sample_id_shares
from ..sources.wide_source import publish_wide, read_wide_source
from .fixtures import CODING_EVENTS, SEGMENTS, SYMBOLS, Tables
from .registry import query


def _rounded(df, column: str = "value", digits: int = 6):
    return df.withColumn(column, F.round(column, digits))


# ------------------------------------------------------------------ sources and sinks


@query("read_wide_source", "SELECT sample_id, gene, value FROM fx_expression", ("fx_expression",))
def read_wide_source_query(t: Tables):
    # Written all or nothing by the data source, and read back by it.
    path, cells = scratch_path(t.spark, "published"), materialise(t.expression(), "expression")
    names = sorted(r["gene"] for r in cells.select("gene").distinct().collect())
    publish_wide(cells, t.samples(), names, path)
    found = read_wide_source(t.spark, path).filter(F.col("value").isNotNull())
    return found.select(F.col("row_id").alias("sample_id"), F.col("column_id").alias("gene"), "value")


@query("read_matrix_unpivot", "SELECT sample_id, gene, value FROM fx_expression", ("fx_expression",))
def read_matrix_unpivot(t: Tables):
    path = scratch_path(t.spark, "matrix")
    write_wide(t.expression(), t.samples(), SYMBOLS, path, sep="\t")
    cells = read_matrix(t.spark, path, "\t").filter(F.col("value").isNotNull())
    return cells.select(F.col("row_id").alias("sample_id"), F.col("column_id").alias("gene"), "value")


@query("read_scoring_csv", "SELECT sample_id, gene, value FROM fx_expression", ("fx_expression",))
def read_scoring_csv(t: Tables):
    path = scratch_path(t.spark, "scoring")
    write_wide(t.expression(), t.samples(), SYMBOLS, path, sep=",")
    return read_scoring_matrix(t.spark, path).filter(F.col("value").isNotNull())


@query("read_mutation_matrix", "SELECT sample_id, target, label FROM fx_mutations", ("fx_mutations",))
def read_mutation_matrix(t: Tables):
    path = scratch_path(t.spark, "calls")
    calls = t.mutations().select("sample_id", F.col("target").alias("gene"), F.col("label").cast("double").alias("value"))
    names = [r["gene"] for r in calls.select("gene").distinct().orderBy("gene").collect()]
    write_wide(calls, t.samples(), names, path, sep="\t")
    cells = read_mutations(t.spark, path).filter(F.col("value").isNotNull())
    return cells.select("sample_id", "target", is_mutated(F.col("value")).alias("label"))


@query(
    "pivot_export",
    "SELECT sample_id, "
    + ", ".join(f"max(CASE WHEN gene = '{s}' THEN value END) AS \"{s}\"" for s in SYMBOLS)
    + " FROM fx_expression GROUP BY sample_id",
    ("fx_expression",),
)
def pivot_export(t: Tables):
    return pivot_wide(t.expression(), SYMBOLS)


@query(
    "detect_orientation",
    """, cells AS (SELECT 'TCGA-' || sample_id AS row_id, target AS column_id FROM fx_mutations)
    SELECT 'row' AS side, count(*) AS n_names, avg(CASE WHEN row_id LIKE 'TCGA-%' THEN 1e0 ELSE 0e0 END) AS share
    FROM (SELECT DISTINCT row_id FROM cells)
    UNION ALL
    SELECT 'column', count(*), avg(CASE WHEN column_id LIKE 'TCGA-%' THEN 1e0 ELSE 0e0 END)
    FROM (SELECT DISTINCT column_id FROM cells)""",
    ("fx_mutations",),
)
def detect_orientation(t: Tables):
    calls = t.mutations()
    return sample_id_shares(calls.select(F.concat(F.lit("TCGA-"), "sample_id")), calls.select("target"))


@query(
    "unique_samples_check",
    "SELECT 'S' || o_custkey AS sample_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
)
def unique_samples_check(t: Tables):
    return duplicate_samples(t.table("orders").select(t.sample("o_custkey").alias("sample_id")))


def _attribute_text():
    kind = F.when(F.col("p_size") % 2 == 0, "gene_type").otherwise("gene_biotype")
    return F.concat(
        F.lit('gene_id "'), F.col("gene_id_version"), F.lit('"; gene_name "'), F.col("symbol"), F.lit('"; '), kind,
        F.lit(' "'), F.col("biotype"), F.lit('";'),
    )


def _attributes(t: Tables):
    size = F.substring_index("gene_id_version", ".", -1).cast("int")
    return t.annotation().withColumn("p_size", size).withColumn("attributes", _attribute_text())


@query("parse_attributes", "SELECT gene_id, symbol, biotype FROM fx_annotation", ("fx_annotation",))
def parse_attributes(t: Tables):
    pos = F.substring("gene_id", 5, 20).cast("bigint")
    return annotation_from_attributes(_attributes(t).select(pos.alias("pos"), "attributes"))


@query("read_annotation_file", "SELECT gene_id, symbol, biotype FROM fx_annotation", ("fx_annotation",))
def read_annotation_file(t: Tables):
    path = scratch_path(t.spark, "annotation")
    fields = F.concat_ws("\t", *[F.lit(x) for x in ("chr1", "made", "gene", "1", "2", ".", "+", ".")], F.col("attributes"))
    _attributes(t).select(fields.alias("value")).write.option("compression", "gzip").text(path)
    return read_annotation(t.spark, path)


@query(
    "status_labels",
    """SELECT 'S' || c_custkey AS sample_id, t.target, CASE WHEN c_mktsegment = t.target THEN 1 ELSE 0 END AS label
    FROM customer, (VALUES ('BUILDING'), ('MACHINERY')) AS t(target)""",
)
def status_label_query(t: Tables):
    rows = t.table("customer").select(
        t.sample("c_custkey").alias("sample_id"),
        F.array(
            F.concat(F.lit(" segment : "), "c_mktsegment", F.lit(" ")), F.concat(F.lit("nation: "), F.col("c_nationkey").cast("string"))
        ).alias("attributes"),
    )
    return status_labels(rows, "segment", {"BUILDING": "BUILDING", "MACHINERY": "MACHINERY"})


@query(
    "resolve_event_columns",
    "SELECT sample_id AS raw_sample, effect AS variant_class, count(*) AS n FROM fx_events GROUP BY 1, 2",
    ("fx_events",),
)
def resolve_event_columns(t: Tables):
    return resolve_events(t.events()).groupBy("raw_sample", "variant_class").agg(F.count(F.lit(1)).alias("n"))


_BURDEN_SQL = """SELECT sample_id, count(*) AS tmb, round(log2(count(*) + 1), 9) AS tmb_log2 FROM fx_events
    WHERE effect IN ('click', 'error', 'purchase') GROUP BY 1"""


@query("read_event_log", _BURDEN_SQL, ("fx_events",))
def read_event_log(t: Tables):
    path = scratch_path(t.spark, "events")
    t.events().select(
        F.col("sample").alias("Tumor_Sample_Barcode"), F.col("effect").alias("Variant_Classification"), "event_id"
    ).write.csv(path, sep="\t", header=True, compression="gzip")
    return _rounded(burden_counts(read_events(t.spark, path), CODING_EVENTS), "tmb_log2", 9)


# ------------------------------------------------------------------ identifiers and values


@query(
    "canonical_id",
    """SELECT k, CASE WHEN raw_id LIKE 'TCGA-%-%-%' THEN
        split_part(raw_id, '-', 1) || '-' || split_part(raw_id, '-', 2) || '-' || split_part(raw_id, '-', 3) || '-' ||
        CASE WHEN length(substring(split_part(raw_id, '-', 4), 1, 3)) = 2 THEN split_part(raw_id, '-', 4) || 'A'
             ELSE substring(split_part(raw_id, '-', 4), 1, 3) END
        ELSE raw_id END AS sample_id FROM fx_ids""",
    ("fx_ids",),
)
def canonical_id(t: Tables):
    return t.ids().select("k", canonical_sample_id(F.col("raw_id")).alias("sample_id"))


@query("strip_version", "SELECT gene_id_version, split_part(gene_id_version, '.', 1) AS gene_id FROM fx_annotation", ("fx_annotation",))
def strip_version_query(t: Tables):
    return t.annotation().select("gene_id_version", strip_version(F.col("gene_id_version")).alias("gene_id"))


@query("cohort_codes", "SELECT c_custkey AS k, c_mktsegment || '|X' || c_nationkey AS codes FROM customer")
def cohort_code_query(t: Tables):
    text = F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(", ,"), "c_mktsegment", F.lit(",x"), F.col("c_nationkey").cast("string"))
    return t.table("customer").select(F.col("c_custkey").alias("k"), F.array_join(cohort_codes(text), "|").alias("codes"))


_PROBE_SQL = """CASE WHEN p_size % 5 = 0 THEN '---' WHEN p_size % 7 = 0 THEN '' WHEN p_size % 11 = 0 THEN 'nan'
    ELSE p_brand || ' /// ' || p_type END"""
_PROBE_SYMBOL_SQL = "CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 OR p_size % 11 = 0 THEN NULL ELSE p_brand END"


def _platform(t: Tables):
    size = F.col("p_size")
    text = (
        F.when(size % 5 == 0, "---").when(size % 7 == 0, "").when(size % 11 == 0, "nan")
        .otherwise(F.concat("p_brand", F.lit(" /// "), "p_type"))
    )
    return t.table("part").select(F.concat(F.lit("ENSG"), F.col("p_partkey").cast("string")).alias("probe"), text.alias("symbols"))


@query("probe_symbol", f"SELECT 'ENSG' || p_partkey AS probe, {_PROBE_SYMBOL_SQL} AS gene FROM part")
def probe_symbol_query(t: Tables):
    return _platform(t).select("probe", probe_symbol(F.col("symbols")).alias("gene"))


@query(
    "probe_collapse",
    f""", p AS (SELECT 'ENSG' || p_partkey AS gene_id, {_PROBE_SYMBOL_SQL} AS gene FROM part)
    SELECT sample_id, gene, round(avg(log2_value), 6) AS value FROM fx_expression_raw JOIN p USING (gene_id)
    WHERE gene IS NOT NULL GROUP BY 1, 2""",
    ("fx_expression_raw",),
)
def probe_collapse(t: Tables):
    return _rounded(probes_to_genes(t.expression_raw().withColumnRenamed("gene_id", "probe"), _platform(t)))


@query(
    "first_duplicate",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity FROM (
        SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS rn
        FROM lineitem) WHERE rn = 1""",
)
def first_duplicate(t: Tables):
    rows = t.table("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return keep_first(rows, ["l_partkey"], ["l_orderkey", "l_linenumber"])


def _transformed(mode: str):
    def build(t: Tables):
        value = transform_expression(F.col("value"), mode)
        return t.expression_raw().select("sample_id", "gene_id", F.round(value, 6).alias("value"))

    return build


_TRANSFORM_SQL = "SELECT sample_id, gene_id, round({}, 6) AS value FROM fx_expression_raw"
query("transform_log1p", _TRANSFORM_SQL.format("ln(1 + greatest(pow(2, log2_value) - 1, 0))"), ("fx_expression_raw",))(_transformed("log1p"))
query("transform_raw", _TRANSFORM_SQL.format("greatest(pow(2, log2_value) - 1, 0)"), ("fx_expression_raw",))(_transformed("raw"))
query("transform_asis", _TRANSFORM_SQL.format("log2_value"), ("fx_expression_raw",))(_transformed("xena"))


@query(
    "binarise",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <= 1 THEN 0 WHEN o_totalprice - 250000 > 0 THEN 1 ELSE 0 END AS label
    FROM orders""",
)
def binarise(t: Tables):
    key = F.col("o_orderkey") % 10
    text = F.when(key == 0, "n/a").when(key == 1, "NaN").otherwise((F.col("o_totalprice") - 250000).cast("string"))
    return t.table("orders").select("o_orderkey", is_mutated(number(text)).alias("label"))


@query("tmb_count", _BURDEN_SQL, ("fx_events",))
def tmb_count(t: Tables):
    return _rounded(burden_counts(resolve_events(t.events()), CODING_EVENTS), "tmb_log2", 9)


@query(
    "tmb_inverse",
    """SELECT sample_id, round(pow(2, truth) - 1, 4) AS tmb_true, round(greatest(pow(2, pred - 5) - 1, 0), 4) AS tmb_pred
    FROM fx_regression""",
    ("fx_regression",),
)
def tmb_inverse(t: Tables):
    return t.regression().select(
        "sample_id",
        F.round(burden_from_log2(F.col("truth"), clip=False), 4).alias("tmb_true"),
        F.round(burden_from_log2(F.col("pred") - 5), 4).alias("tmb_pred"),
    )


# ------------------------------------------------------------------ collapse and joins


def _named(t: Tables):
    return annotate(t.expression_raw(), t.annotation())


@query(
    "annotate_genes",
    """SELECT sample_id, gene_id, symbol AS gene, log2_value AS value FROM fx_expression_raw JOIN fx_annotation USING (gene_id)
    WHERE biotype = 'protein_coding'""",
    ("fx_expression_raw", "fx_annotation"),
)
def annotate_genes(t: Tables):
    return _named(t).select("sample_id", "gene_id", "gene", "value")


def _collapsed(how: str):
    return lambda t: _rounded(collapse(_named(t), how))


_COLLAPSE_SQL = """SELECT sample_id, symbol AS gene, round({}, 6) AS value FROM fx_expression_raw JOIN fx_annotation USING (gene_id)
    WHERE biotype = 'protein_coding' GROUP BY 1, 2"""
for _how, _sql in {
    "mean": "avg(log2_value)",
    "sum": "coalesce(sum(log2_value), 0)",
    "first": "arg_min(log2_value, cast(substring(gene_id, 5) AS BIGINT))",
}.items():
    query(f"collapse_{_how}", _COLLAPSE_SQL.format(_sql), ("fx_expression_raw", "fx_annotation"))(_collapsed(_how))


@query(
    "semi_targets",
    """SELECT 'S' || o_custkey AS sample_id, 'SYM' || l_partkey AS target,
        max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    WHERE p_type IN ('ECONOMY', 'PROMO', 'SMALL') GROUP BY 1, 2""",
)
def semi_targets(t: Tables):
    orders = t.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    calls = (
        t.table("lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(orders, "l_orderkey")
        .groupBy(t.sample("o_custkey").alias("sample_id"), F.concat(F.lit("SYM"), F.col("l_partkey").cast("string")).alias("target"))
        .agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))
    )
    annotation = t.annotation().withColumn("symbol", F.regexp_replace("gene_id", "^ENSG", "SYM"))
    return co.restrict_targets(calls, annotation)


def _cohort(t: Tables) -> co.Cohort:
    return co.Cohort(t.samples(), t.expression(), t.mutations())


_CHOSEN = "SELECT sample_id, target, label FROM fx_mutations WHERE sample_id {} (SELECT sample_id FROM fx_samples WHERE cancer = 'BUILDING')"


@query("subset_semi", _CHOSEN.format("IN"), ("fx_mutations", "fx_samples"))
def subset_semi(t: Tables):
    chosen = t.samples().filter(F.col("cancer") == "BUILDING")
    return _cohort(t).subset(samples=chosen).mutations


@query("holdout_anti", _CHOSEN.format("NOT IN"), ("fx_mutations", "fx_samples"))
def holdout_anti(t: Tables):
    return _cohort(t).without(t.samples().filter(F.col("cancer") == "BUILDING")).mutations


@query(
    "match_samples",
    "SELECT DISTINCT sample_id FROM fx_expression_raw INTERSECT SELECT DISTINCT sample_id FROM fx_events",
    ("fx_expression_raw", "fx_events"),
)
def match_samples(t: Tables):
    return co.match_samples(t.expression_raw(), t.events().withColumnRenamed("sample", "sample_id"))


@query(
    "align_labels",
    f"""SELECT sample_id, cancer, tmb, tmb_log2 FROM fx_samples LEFT JOIN ({_BURDEN_SQL}) USING (sample_id)""",
    ("fx_samples", "fx_events"),
)
def align_labels(t: Tables):
    return co.align_labels(t.samples(), tmb_count(t))


@query(
    "cohort_summary",
    """SELECT (SELECT count(DISTINCT sample_id) FROM fx_samples) AS n_samples,
        (SELECT count(DISTINCT gene) FROM fx_expression) AS n_features,
        (SELECT count(DISTINCT target) FROM fx_mutations) AS n_targets,
        (SELECT string_agg(cancer, '|' ORDER BY cancer) FROM (SELECT DISTINCT cancer FROM fx_samples)) AS cancers""",
    ("fx_samples", "fx_expression", "fx_mutations"),
)
def cohort_summary(t: Tables):
    return _cohort(t).summary().withColumn("cancers", F.array_join("cancers", "|"))


# ------------------------------------------------------------------ unions


def _by_cohort(t: Tables, table):
    # Read once per cohort and use below.
    tagged = materialise(table.join(t.samples(), "sample_id"), "tagged")
    return {s: tagged.filter(F.col("cancer") == s).drop("cancer") for s in SEGMENTS}


@query(
    "union_shared_genes",
    """, x AS (SELECT r.sample_id, gene_id AS gene, log2_value AS value, cancer FROM fx_expression_raw r JOIN fx_samples USING (sample_id))
    SELECT sample_id, gene, value, cancer FROM x
    WHERE gene IN (SELECT gene FROM x GROUP BY gene HAVING count(DISTINCT cancer) = 5)""",
    ("fx_expression_raw", "fx_samples"),
)
def union_shared_genes(t: Tables):
    cells = t.expression_raw().select("sample_id", F.col("gene_id").alias("gene"), "value")
    return co.union_shared_genes(_by_cohort(t, cells))


@query(
    "union_all_targets",
    """SELECT s.sample_id, t.target, coalesce(m.label, 0) AS label FROM fx_samples s
    CROSS JOIN (SELECT DISTINCT target FROM fx_mutations) t
    LEFT JOIN fx_mutations m ON m.sample_id = s.sample_id AND m.target = t.target""",
    ("fx_samples", "fx_mutations"),
)
def union_all_targets(t: Tables):
    stacked = co.union_all_targets(_by_cohort(t, t.mutations()))
    targets = [r["target"] for r in stacked.select("target").distinct().orderBy("target").collect()]
    return co.explicit_labels(stacked, t.samples().select("sample_id"), targets)


@query(
    "prepared_cache",
    "SELECT sample_id, gene, value FROM fx_expression",
    ("fx_expression",),
)
def prepared_cache(t: Tables):
    directory = scratch_path(t.spark, "cache")
    settings = {"source": t.directory, "transform": "log1p"}
    cached_cohort(t.spark, directory, settings, lambda: _cohort(t))
    return cached_cohort(t.spark, directory, settings, lambda: _cohort(t)).expression
