"""Writers: wide CSV export and named result bundles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import dense_rows, with_index

# A character that no identifier or number contains; it keeps a composed CSV line in one field.
_UNUSED = "\u0001"


def wide_lines(
    cells: DataFrame, samples: DataFrame, features: list[str], sep: str = ",", fill: float | None = None
) -> DataFrame:
    """One text column: a delimited line per sample, named by the header line. Missing cells are empty or filled.

    The feature names travel inside one column name, so the plan stays small however wide the matrix is.
    """
    dense = dense_rows(with_index(cells, features), samples.select("sample_id"), len(features), fill)
    fields = F.transform("features", lambda x: F.coalesce(x.cast("string"), F.lit("")))
    line = F.concat_ws(sep, F.col("sample_id"), F.array_join(fields, sep))
    return dense.select(line.alias(sep.join(["sample_id", *features])))


def write_wide(
    cells: DataFrame, samples: DataFrame, features: list[str], path: str, sep: str = ",", compression: str = "gzip",
    fill: float | None = None,
) -> None:
    """Samples in rows, features in columns; each part file carries the header."""
    wide_lines(cells, samples, features, sep, fill).write.csv(
        path, sep=_UNUSED, header=True, compression=compression, quote="", mode="errorifexists"
    )


def export_cohort(cohort, path: str, wide: bool = True) -> dict:
    """Prepared tables below ``path``: samples, then expression and mutations, wide as CSV or long as Parquet.

    Names of genes and targets come to the driver for a wide header; the cells never do.
    """
    samples = cohort.samples
    samples.write.mode("errorifexists").csv(f"{path}/samples", header=True)
    tables = {"expression": cohort.expression, "mutations": cohort.mutations}
    for name, table in tables.items():
        if table is None:
            continue
        if not wide:
            table.write.mode("errorifexists").parquet(f"{path}/{name}")
            continue
        key, value = ("gene", F.col("value")) if name == "expression" else ("target", F.col("label").cast("double"))
        cells = table.select("sample_id", F.col(key).alias("gene"), value.alias("value"))
        names = sorted(r["gene"] for r in cells.select("gene").distinct().collect())
        fill = None if name == "expression" else 0.0
        write_wide(cells, samples, names, f"{path}/{name}", fill=fill)
    return cohort.summary().first().asDict()


def pivot_wide(cells: DataFrame, features: list[str]) -> DataFrame:
    """Wide DataFrame for a short, explicit feature list."""
    return cells.groupBy("sample_id").pivot("gene", features).agg(F.first("value"))


def write_bundle(spark: SparkSession, path: str, tables: dict[str, DataFrame], metadata: dict) -> str:
    """Each table as Parquet below ``path``; the metadata row goes last, so its presence means complete."""
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}")
    text = json.dumps(metadata, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/metadata")
    return path


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()["value"])
