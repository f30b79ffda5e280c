"""Operators keep columns of the input whatever they are called."""

import pytest
from pyspark.sql import functions as F

from strandfold.llm import decontaminate, mixing, neardup, packing, shards

NAMES = "_p _key _gone _source _lang _topic _first _offset _n _file _row row given n_words hit_spans item_ids doc size_ file at first gone".split()


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a"), (2, text, "en", "b"), (3, "other words " * 9, "de", "a"), (4, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in NAMES])


def unchanged(rows, but=()):
    return rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in NAMES if n not in but)


def test_mixing(docs):
    got = mixing.sample_by_weight(docs).collect()
    assert len(got) == 4 and unchanged(got)


def test_near_duplicates(docs):
    got = neardup.deduplicate(docs).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3, 4] and unchanged(got)


def test_shards(docs):
    got = shards.number_slots(shards.assign_shards(docs, 2)).collect()
    assert len(got) == 4 and unchanged(got)
    for shard in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_decontamination(spark, docs):
    items = spark.createDataFrame([("x", " ".join(f"word{i}" for i in range(5, 20)))], "item_id string, text string")
    got = decontaminate.decontaminate(docs, items)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [3, 4] and unchanged(got.collect())
    cut = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, items, "spans").collect()}
    assert len(cut[1]["text"].split()) == 25 and unchanged(list(cut.values()))


def test_packing_reads_two_columns(docs):
    assert packing.pack(docs).columns == packing.PACKED.names
