"""The wide reader: quoted fields, and independence from how files are split."""

import gzip

from pyspark.sql import functions as F

from strandfold.sources.matrix import delimited_fields, first_field, read_matrix, read_scoring_matrix, read_wide


def test_fields(spark):
    lines = ['a,b,,c', ',x,', '"a,1","say ""hi""",', '"",plain,"q"', '"open,b', 'a "mid" b,2', ""]
    want = [["a", "b", "", "c"], ["", "x", ""], ["a,1", 'say "hi"', ""], ["", "plain", "q"], ['"open', "b"], ['a "mid" b', "2"], [""]]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").orderBy("i")
    got = frame.select(delimited_fields(F.col("line"), ",").alias("f"), first_field(F.col("line"), ",").alias("first")).collect()
    assert [r["f"] for r in got] == want and [r["first"] for r in got] == [w[0] for w in want]
    wide = frame.limit(1).select(delimited_fields(F.lit('"' + "x" * 50_000 + '"\t' + "\t".join(["1"] * 5000)), "\t").alias("f"))
    assert len(wide.first()["f"]) == 5001


def test_quoted_matrix(spark, tmp_path):
    path = tmp_path / "scores.csv"
    path.write_text('"","G1","G,2"\n"S1","1.5",2\n"S2",,"-3e1"\n')
    rows = sorted((r["sample_id"], r["gene"], r["value"]) for r in read_scoring_matrix(spark, str(path)).collect())
    assert rows == [("S1", "G,2", 2.0), ("S1", "G1", 1.5), ("S2", "G,2", -30.0), ("S2", "G1", None)]


def test_no_row_depends_on_the_split(spark, tmp_path):
    for f in range(6):
        body = "".join(f"r{f}_{i}\t{i}\t{i + 1}\n" for i in range(200 + 30 * f))
        data = f"id\tA{f % 2}\tB\n{body}"
        if f % 2:
            with gzip.open(tmp_path / f"m{f}.tsv.gz", "wt") as out:
                out.write(data)
        else:
            (tmp_path / f"m{f}.tsv").write_text(data)
    total = 2 * sum(200 + 30 * f for f in range(6))
    matrix = read_wide(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.files.minPartitionNum", None), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        counts = []
        for least, most in (("1", "128m"), ("40", "4k"), ("3", "1m")):
            spark.conf.set("spark.sql.files.minPartitionNum", least)
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            counts += [matrix.cells().count(), read_matrix(spark, str(tmp_path)).count()]
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before[0] is None else spark.conf.set("spark.sql.files.minPartitionNum", before[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[1])
    assert counts == [total] * 6
    assert matrix.rows.filter(F.col("row_id") == "id").count() == 0
