"""Gene annotation (GTF) reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import quoted_attribute, strip_version

# The nine columns of a GTF line.
GTF_FIELDS = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """``gene_id, symbol, biotype``, one row per gene id: the first in file order."""
    lines = spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
        ).alias("pos"),
        F.split("value", "\t", -1).alias("fields"),
        F.col("value").startswith("#").alias("is_comment"),
    )
    genes = lines.filter(
        ~F.col("is_comment") & (F.size("fields") == len(GTF_FIELDS)) & (F.get("fields", F.lit(2)) == "gene")
    )
    return annotation_from_attributes(genes.select("pos", F.get("fields", F.lit(8)).alias("attributes")))


def annotation_from_attributes(genes: DataFrame) -> DataFrame:
    """Annotation rows from ``pos, attributes``; rows without id or symbol are dropped."""
    parsed = genes.select(
        "pos",
        strip_version(quoted_attribute(F.col("attributes"), "gene_id")).alias("gene_id"),
        quoted_attribute(F.col("attributes"), "gene_name").alias("symbol"),
        F.coalesce(
            quoted_attribute(F.col("attributes"), "gene_type"), quoted_attribute(F.col("attributes"), "gene_biotype")
        ).alias("biotype"),
    ).filter((F.col("gene_id") != "") & F.col("symbol").isNotNull())
    return parsed.groupBy("gene_id").agg(
        F.min_by("symbol", "pos").alias("symbol"), F.min_by("biotype", "pos").alias("biotype")
    )
