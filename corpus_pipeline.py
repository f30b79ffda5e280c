"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, contaminated documents go,
sources are mixed to target weights, and what is left is packed into token rows.

Each stage takes (spark, docs, sf_dir) and gives the next stage's documents; the last gives packed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandfold.llm import decontaminate, mixing, neardup, packing, toxicity
from strandfold.llm.common import table
from strandfold.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample_by_weight(docs, power=MIX_POWER).filter("sampled").select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


#: Five words and a similarity of 0.8 or more (op2 has its own 0.85): banding misses a link at 0.8 with a chance of (1 - 0.8^6)^46 < 1e-6.
NEAR = neardup.Settings(percent=80, bands=46, rows=6)

#: Targets are shares of tokens to this power: a source of 60 times the tokens of another is drawn at two thirds of its rate.
MIX_POWER = 0.9

STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Trees, raking and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
