"""The data source of wide matrices: ranges, pushed filters, and writing all or nothing."""

import gzip
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from strandfold.sources import wide_source as ws
from strandfold.sources.matrix import read_matrix

LINES = ["id\tA\tB\t\"C\tc\"\tA", "x1\t1.5\t\tNA\t4", "", "x2\t-2\t3\t\"4\"\t\"a\"\"b\"", "\"x 3\"\t7", "x4\t1e3\t 5 \tnan\t9\textra"]


def cells(text=LINES):
    out = []
    names = ws.split_fields(text[0], "\t")
    for line in text[1:]:
        fields = ws.split_fields(line, "\t")
        out += [(fields[0], names[i], i, fields[i]) for i in range(1, min(len(fields), len(names)))] if line else []
    return sorted(out)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.tsv").write_text("\n".join(LINES) + "\n")
    (tmp_path / "b.tsv").write_bytes("\r\n".join(LINES).encode())
    with gzip.open(tmp_path / "c.tsv.gz", "wt") as f:
        f.write("\n".join(LINES))
    (tmp_path / "_SUCCESS").write_text("no data")
    return str(tmp_path)


def taken(rows):
    return sorted((r["row_id"], r["column_id"], r["column_pos"], r["text"]) for r in rows)


@pytest.mark.parametrize("split", [1, 7, 40, 10**6])
def test_ranges_of_any_size_give_every_cell_once(spark, folder, split):
    ws.register(spark)
    found = spark.read.format("wide").option("splitBytes", split).load(folder)
    got = found.collect()
    for name in ("a.tsv", "b.tsv", "c.tsv.gz"):
        assert taken(r for r in got if r["file"].endswith(name)) == cells(), name
    order = sorted((r["row_pos"], r["row_id"]) for r in got if r["file"].endswith("a.tsv"))
    assert list(dict.fromkeys(i for _, i in order)) == ["x1", "x2", "x 3", "x4"]


def test_values_equal_those_of_the_stored_reader(spark, folder):
    path = f"{folder}/a.tsv"
    one = ws.read_wide_source(spark, path).filter("value IS NOT NULL").select("row_id", "column_id", "value").collect()
    two = read_matrix(spark, path, "\t").filter("value IS NOT NULL").select("row_id", "column_id", "value").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) > 6


def test_filters_are_pushed_and_only_wanted_fields_are_parsed(spark, tmp_path):
    names = [f"g{i}" for i in range(500)]
    text = ["id\t" + "\t".join(names)] + [f"s{i}\t" + "\t".join(str(i * j) for j in range(500)) for i in range(40)]
    path = str(tmp_path / "m.tsv")
    (tmp_path / "m.tsv").write_text("\n".join(text))
    reader = ws.WideReader({"path": path})
    other = GreaterThan(("row_pos",), 0)
    assert list(reader.pushFilters([In(("column_id",), ("g3", "g499", "g7")), other])) == [other]
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert reader.parsed == 3 * 40 and sum(b.num_rows for b in batches) == 120
    narrow = ws.WideReader({"path": path})
    assert not list(narrow.pushFilters([EqualTo(("row_id",), "s5"), In(("column_id",), ("g1", "g2"))]))
    assert [r for part in narrow.partitions() for b in narrow.read(part) for r in b.column("text").to_pylist()] == ["5", "10"] and narrow.parsed == 2
    found = ws.read_wide_source(spark, path).filter(F.col("column_id").isin("g3", "g499", "g7") & (F.col("value") > 1000))
    assert {(r["row_id"], r["column_id"], r["value"]) for r in found.collect()} == {(f"s{i}", f"g{j}", float(i * j)) for i in range(40) for j in (3, 7, 499) if i * j > 1000}


def matrix(spark):
    values = [(f"s{i}", f"g{j}", float(i + j / 10)) for i in range(30) for j in range(4) if (i + j) % 5]
    cells_ = spark.createDataFrame(values, "sample_id string, gene string, value double")
    return cells_, cells_.select("sample_id").distinct(), values


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_published_files_read_back(spark, tmp_path, compression):
    cells_, samples, values = matrix(spark)
    path = str(tmp_path / "out" / "wide")
    os.makedirs(tmp_path / "out")
    ws.publish_wide(cells_, samples, ["g0", "g1", "g2", "g3"], path, compression=compression)
    assert os.listdir(tmp_path / "out") == ["wide"]
    got = ws.read_wide_source(spark, path).filter("value IS NOT NULL")
    assert sorted((r["row_id"], r["column_id"], r["value"]) for r in got.collect()) == sorted(values)
    with pytest.raises(Exception, match="FileExists"):
        ws.publish_wide(cells_, samples, ["g0"], path)


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "wide")
    ws.register(spark)
    lines = spark.range(0, 400, 1, 4).select(F.when(F.col("id") == 399, F.raise_error(F.lit("broken line"))).otherwise(F.col("id").cast("string")).alias("id\tg"))
    with pytest.raises(Exception, match="broken line"):
        lines.write.format("wide").mode("append").save(path)
    assert os.listdir(tmp_path) == []
