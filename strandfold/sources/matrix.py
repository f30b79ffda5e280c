"""Readers for wide delimited matrices, all into one long form.

A wide file has one header line; its names are data here, never schema, so a matrix may have any number of
columns. Questions about row names are answered from the unexploded rows and questions about column names
from the headers, so only readers of values pay for the cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import canonical_sample_id
from ..functions.values import number
from ..session import materialise

SAMPLE_PREFIX = "TCGA-"


@dataclass(frozen=True)
class WideMatrix:
    """rows(file, header_id, row_pos, row_id, fields) and columns(header_id, column_pos, column_id)."""

    rows: DataFrame
    columns: DataFrame

    def cells(self) -> DataFrame:
        """``file, row_id, column_id, row_pos, column_pos, value``; text that is not a number is NULL.

        The column table is small (one row per column of each different header) and stored, so Spark knows
        its true size and broadcasts it where that is small: the cells leave the scan without a shuffle.
        """
        # The outer form keeps Spark from testing the split for emptiness once more in the scan.
        exploded = self.rows.select(
            "file", "header_id", "row_pos", "row_id", F.posexplode_outer("fields").alias("column_pos", "text")
        ).filter(F.col("column_pos") > 0)
        return exploded.join(self.columns, ["header_id", "column_pos"]).select(
            "file", "row_id", "column_id", "row_pos", "column_pos", number(F.col("text")).alias("value")
        )


def delimited_fields(line: Column, sep: str) -> Column:
    """The fields of a line. A field in double quotes may hold the separator; a doubled quote inside is one quote."""
    literal = "\\Q" + sep + "\\E"
    # Every field is matched with a separator before it, so that empty ones are found too.
    quoted = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(literal + r'("(?:[^"]++|"")*+"|(?:(?!' + literal + r").)*+)"), 1)
    plain = F.transform(quoted, lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(line.contains('"'), plain).otherwise(F.split(line, literal, -1))


def first_field(line: Column, sep: str) -> Column:
    """The first field, without splitting the line where nothing is quoted."""
    return F.when(line.contains('"'), F.get(delimited_fields(line, sep), F.lit(0))).otherwise(F.substring_index(line, sep, 1))


def read_wide(spark: SparkSession, path: str, sep: str = "\t") -> WideMatrix:
    """One or more wide files, plain or compressed; every file brings its own header line.

    The files are scanned once. Lines are stored with the position that this scan gave them, so nothing later depends
    on how files are split; and they are dealt out by size first, since a compressed file arrives in a single task.
    A quoted field may not hold a line break.
    """
    scanned = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        # Block offset and reading order together follow the order of lines inside a file.
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
        ).alias("row_pos"),
        "value",
    ).filter(F.length("value") > 0)
    lines = materialise(scanned.hint("rebalance"), "lines")
    heads = lines.groupBy("file").agg(F.min("row_pos").alias("header_pos"))
    headers = lines.join(heads, "file").filter(F.col("row_pos") == F.col("header_pos")).select("file", "header_pos", F.col("value").alias("header"))
    headers = materialise(headers.withColumn("header_id", F.sha2("header", 256)), "headers")
    columns = headers.groupBy("header_id").agg(F.min("header").alias("header")).select(
        "header_id", F.posexplode(delimited_fields(F.col("header"), sep)).alias("column_pos", "column_id")
    )
    columns = materialise(columns.filter(F.col("column_pos") > 0), "columns")
    body = lines.join(headers.select("file", "header_id", "header_pos"), "file").filter(F.col("row_pos") > F.col("header_pos"))
    rows = body.select(
        "file", "header_id", "row_pos", first_field(F.col("value"), sep).alias("row_id"), delimited_fields(F.col("value"), sep).alias("fields")
    )
    return WideMatrix(rows, columns)


def read_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return read_wide(spark, path, sep).cells()


def sample_id_shares(row_names: DataFrame, column_names: DataFrame) -> DataFrame:
    """Share of sample-like names among the distinct names of either side (one name column each)."""
    sides = [
        df.toDF("name").distinct().select(F.lit(side).alias("side"), F.col("name").startswith(SAMPLE_PREFIX).alias("is_sample"))
        for side, df in (("row", row_names), ("column", column_names))
    ]
    share = F.avg(F.col("is_sample").cast("double"))
    return sides[0].unionByName(sides[1]).groupBy("side").agg(F.count(F.lit(1)).alias("n_names"), share.alias("share"))


def _samples_in_rows(matrix: WideMatrix, feature: str) -> DataFrame:
    """``sample_id, <feature>, value`` of a samples-in-rows matrix; of rows for one sample the first is kept."""
    named = matrix.rows.withColumn("sample_id", canonical_sample_id(F.col("row_id")))
    first = named.groupBy("sample_id").agg(F.min("row_pos").alias("row_pos"))
    kept = WideMatrix(named.join(first, ["sample_id", "row_pos"]).withColumn("row_id", F.col("sample_id")), matrix.columns)
    return kept.cells().select(
        F.col("row_id").alias("sample_id"), F.col("column_id").alias(feature), "value", F.col("column_pos").alias(f"{feature}_pos")
    )


def _samples_in_columns(matrix: WideMatrix, feature: str) -> DataFrame:
    """``sample_id, <feature>, value`` of a samples-in-columns matrix; the header alone decides what is kept."""
    named = matrix.columns.withColumn("sample_id", canonical_sample_id(F.col("column_id")))
    first = named.groupBy("header_id", "sample_id").agg(F.min("column_pos").alias("column_pos"))
    columns = materialise(first.withColumnRenamed("sample_id", "column_id"), "sample_columns")
    return WideMatrix(matrix.rows, columns).cells().select(
        F.col("column_id").alias("sample_id"), F.col("row_id").alias(feature), "value", F.col("row_pos").alias(f"{feature}_pos")
    )


def read_expression(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """One cohort's file, features in rows and samples in columns: ``sample_id, gene_id, value, gene_id_pos``."""
    return _samples_in_columns(read_wide(spark, path, sep), "gene_id")


def read_mutations(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """One cohort's mutation matrix in either orientation: ``sample_id, target, value, target_pos``."""
    matrix = read_wide(spark, path, sep)
    shares = {
        r["side"]: r["share"]
        for r in sample_id_shares(matrix.rows.select("row_id"), matrix.columns.select("column_id")).collect()
    }
    if shares.get("column", 0.0) > shares.get("row", 0.0):
        return _samples_in_columns(matrix, "target")
    return _samples_in_rows(matrix, "target")


def duplicate_samples(rows: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Ids that head more than one row."""
    return rows.groupBy(sample).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def read_scoring_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Samples in rows, genes in columns: ``sample_id, gene, value``. A repeated sample id is an error."""
    matrix = read_wide(spark, path, sep)
    if duplicate_samples(matrix.rows.select("row_id"), "row_id").limit(1).count():
        raise ValueError("Sample ids that head the rows of an expression matrix have to be unique.")
    return matrix.cells().select(F.col("row_id").alias("sample_id"), F.col("column_id").alias("gene"), "value")
