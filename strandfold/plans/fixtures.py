"""The driver's tables in the roles of a cohort study, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import transform_expression
from ..operators.cohort import Cohort
from ..operators.collapse import annotate, collapse

# Fixed values of the generated tables.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CODING_TYPES = ["ECONOMY", "PROMO", "SMALL"]
CODING_EVENTS = ["click", "error", "purchase"]
SYMBOLS = [f"Brand#{i}" for i in range(1, 26)]

VIEWS = {
    "fx_samples": "SELECT 'S' || c_custkey AS sample_id, c_mktsegment AS cancer FROM customer",
    "fx_ids": """SELECT c_custkey AS k,
        CASE WHEN c_custkey % 7 = 0 THEN 'X-' ELSE 'TCGA-' END || c_nationkey || '-' || c_custkey ||
        CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN '-01' ELSE '-01A-01R' END AS raw_id
        FROM customer""",
    "fx_annotation": """SELECT 'ENSG' || p_partkey || '.' || p_size AS gene_id_version, 'ENSG' || p_partkey AS gene_id,
        p_brand AS symbol,
        CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'SMALL') THEN 'protein_coding' ELSE 'lncRNA' END AS biotype FROM part""",
    "fx_expression_raw": """SELECT 'S' || o_custkey AS sample_id, 'ENSG' || l_partkey AS gene_id,
        round(log2(avg(l_quantity) + 1), 9) AS log2_value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "fx_expression": """SELECT sample_id, symbol AS gene,
        round(avg(ln(1 + greatest(pow(2, log2_value) - 1, 0))), 6) AS value
        FROM fx_expression_raw JOIN fx_annotation USING (gene_id) WHERE biotype = 'protein_coding' GROUP BY 1, 2""",
    "fx_mutations": """SELECT 'S' || o_custkey AS sample_id, o_orderpriority AS target,
        max(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END) AS label FROM orders GROUP BY 1, 2""",
    "fx_events": "SELECT 'S' || user_id AS sample_id, event_type AS effect, event_id, ts FROM events",
    "fx_scores": """SELECT vec_id, 'L' || t.t AS target, CASE WHEN label = t.t THEN 1 ELSE 0 END AS truth,
        round((vec_id % 97) / 97e0 + CASE WHEN label = t.t THEN 0.2e0 ELSE 0e0 END, 9) AS probability
        FROM embeddings, (SELECT unnest(range(10)) AS t) t""",
    "fx_regression": """SELECT sample_id, cancer, truth, truth * 0.5e0 + k % 11 AS pred FROM (
        SELECT 'S' || c_custkey AS sample_id, c_mktsegment AS cancer, c_custkey AS k,
        round(log2(abs(c_acctbal) + 1), 6) AS truth FROM customer)""",
}
NEEDS = {"fx_expression": ["fx_expression_raw", "fx_annotation"]}


def sql_with(views: list[str], body: str) -> str:
    """``body`` preceded by the named views and what they need; a body that starts with a comma adds more."""
    order: list[str] = []
    for view in views:
        for name in [*NEEDS.get(view, []), view]:
            if name not in order:
                order.append(name)
    if not order:
        return "WITH" + body[1:] if body.startswith(",") else body
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order) + "\n" + body


class Tables:
    """Spark side of the views, over one data directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def sample(self, key: str):
        return F.concat(F.lit("S"), F.col(key).cast("string"))

    def samples(self) -> DataFrame:
        return self.table("customer").select(self.sample("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("cancer"))

    def ids(self) -> DataFrame:
        key = F.col("c_custkey")
        prefix = F.when(key % 7 == 0, "X-").otherwise("TCGA-")
        suffix = F.when(key % 5 == 0, "").when(key % 2 == 0, "-01").otherwise("-01A-01R")
        raw = F.concat(prefix, F.col("c_nationkey").cast("string"), F.lit("-"), key.cast("string"), suffix)
        return self.table("customer").select(key.alias("k"), raw.alias("raw_id"))

    def annotation(self) -> DataFrame:
        gene = F.concat(F.lit("ENSG"), F.col("p_partkey").cast("string"))
        return self.table("part").select(
            F.concat(gene, F.lit("."), F.col("p_size").cast("string")).alias("gene_id_version"),
            gene.alias("gene_id"),
            F.col("p_brand").alias("symbol"),
            F.when(F.col("p_type").isin(CODING_TYPES), "protein_coding").otherwise("lncRNA").alias("biotype"),
        )

    def expression_raw(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        return (
            lines.join(orders, "l_orderkey")
            .groupBy("o_custkey", "l_partkey")
            .agg(F.avg("l_quantity").alias("q"))
            .select(
                self.sample("o_custkey").alias("sample_id"),
                F.concat(F.lit("ENSG"), F.col("l_partkey").cast("string")).alias("gene_id"),
                F.round(F.log2(F.col("q") + 1), 9).alias("value"),
                F.col("l_partkey").alias("gene_pos"),
            )
        )

    def expression(self) -> DataFrame:
        cells = self.expression_raw().withColumn("value", transform_expression(F.col("value"), "log1p"))
        return collapse(annotate(cells, self.annotation())).withColumn("value", F.round("value", 6))

    def mutations(self) -> DataFrame:
        return self.table("orders").groupBy(
            self.sample("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("target")
        ).agg(F.max((F.col("o_totalprice") > 400000).cast("int")).alias("label"))

    def events(self) -> DataFrame:
        return self.table("events").select(
            self.sample("user_id").alias("sample"), F.col("event_type").alias("effect"), "event_id", "ts"
        )

    def scores(self) -> DataFrame:
        rows = self.table("embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("t"))
        truth = (F.col("label") == F.col("t")).cast("int")
        score = F.round((F.col("vec_id") % 97) / 97 + F.when(truth == 1, 0.2).otherwise(0.0), 9)
        return rows.select(
            "vec_id", F.concat(F.lit("L"), F.col("t").cast("string")).alias("target"), truth.alias("truth"), score.alias("probability")
        )

    def regression(self) -> DataFrame:
        truth = F.round(F.log2(F.abs("c_acctbal") + 1), 6)
        return self.table("customer").select(
            self.sample("c_custkey").alias("sample_id"),
            F.col("c_mktsegment").alias("cancer"),
            truth.alias("truth"),
            (truth * 0.5 + F.col("c_custkey") % 11).alias("pred"),
        )

    def vectors(self) -> DataFrame:
        """Embedding rows as dense samples: sample_id, cancer, label, features."""
        return self.table("embeddings").select(
            F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("sample_id"),
            F.concat(F.lit("C"), (F.col("label") % 3).cast("string")).alias("cancer"),
            "label",
            F.col("embedding").cast("array<double>").alias("features"),
        )

    def vector_cohort(self) -> Cohort:
        """Embedding rows as a cohort: positions are genes, the label one-vs-rest gives the targets."""
        rows = self.vectors()
        cells = rows.select("sample_id", F.posexplode("features").alias("idx", "value")).select(
            "sample_id", F.format_string("G%03d", "idx").alias("gene"), "value"
        )
        calls = rows.select("sample_id", F.concat(F.lit("T"), F.col("label").cast("string")).alias("target"), F.lit(1).alias("label"))
        count = F.greatest(F.round(40 * (1 + 2 * F.col("features")[0] + F.col("features")[1])), F.lit(0.0)).cast("bigint")
        burden = rows.select("sample_id", count.alias("tmb")).withColumn("tmb_log2", F.log2(F.col("tmb") + 1.0))
        return Cohort(rows.select("sample_id", "cancer"), cells, calls, burden)
