"""The registered queries: against SQL where there is one, and the pipeline stage by stage."""

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from strandfold.llm import mixing, neardup
from strandfold.llm.queries import ORACLES, QUERIES

TABLES = "documents pages benchmark labels conversations embeddings".split()


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data_dir}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, data_dir, duck, name):
    got = QUERIES[name](spark, data_dir)
    columns = sorted(got.columns)
    cursor = duck.execute(ORACLES[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    want = sorted(repr(tuple(r[found.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == want


def test_all_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op1_divergence", "op4_toxicity", "op8_minimax_shards", "op9_mix_sources"])
def test_a_row_for_every_document(spark, data_dir, name):
    got, n = QUERIES[name](spark, data_dir), pq.read_table(f"{data_dir}/documents.parquet").num_rows
    rows = got.collect()
    assert len(rows) == n and len({r["doc_id"] for r in rows}) == n


def test_pipeline_stages(spark, data_dir, duck):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    # An input that has what the given one lacks: nulls, repeated rows, an empty text and a clashing column.
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6, None, None, None, None), (None, "no id at all here", "en", "src0", 4), (10**6 + 1, "", "en", "src0", 0)], docs.schema)
    docs = docs.unionByName(odd)
    seen = {"given": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data_dir)
        if name != "packing":
            assert docs.columns == odd.columns
        docs = docs.persist()
        seen[name] = docs
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in seen.items() if k != "packing"}
    toxic = {r[0] for r in duck.execute("SELECT doc_id FROM labels WHERE toxic = 1").fetchall()}
    clean = {r[0] for r in duck.execute("SELECT doc_id FROM labels WHERE toxic = 0").fetchall()}
    assert len(toxic & ids["toxicity"]) <= 0.5 * len(toxic) and len(clean - ids["toxicity"]) <= 0.02 * len(clean)
    groups = neardup.near_duplicates(seen["toxicity"], corpus_pipeline.NEAR).collect()
    assert ids["near_duplicates"] == {r["doc_id"] for r in groups if r["kept"]}
    dirty = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({ORACLES['op6_decontaminate']}) WHERE contaminated").fetchall()}
    assert ids["decontamination"] == ids["near_duplicates"] - dirty
    drawn = mixing.sample_by_weight(seen["decontamination"], power=corpus_pipeline.MIX_POWER).filter("sampled")
    assert ids["mixing"] == {r["doc_id"] for r in drawn.collect()} and len(ids["mixing"]) > 0.4 * len(ids["decontamination"])
    packed = seen["packing"].select(F.explode("doc_ids").alias("d")).distinct().collect()
    with_text = {r["doc_id"] for r in seen["mixing"].filter(F.length("text") > 0).collect()}
    assert {r["d"] for r in packed} == with_text
