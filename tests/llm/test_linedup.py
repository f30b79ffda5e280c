"""Repeated line runs against brute force."""

import random
import re

from strandfold.llm import linedup as ld


def brute(rows, least):
    """Deleted original line numbers by row, for rows in their order."""
    sequences = []
    for row, (doc, text) in enumerate(rows):
        lines = [(i, x) for i, x in enumerate((text or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] if text is not None else []
        sequences.append((doc, row, lines))
    sequences.sort(key=lambda s: (s[0] is not None, s[0] or 0, s[1]))
    seen, gone = {}, {row: set() for row in range(len(rows))}
    for order, (_, row, lines) in enumerate(sequences):
        for p in range(len(lines)):
            for e in range(p + 1, min(len(lines), p + least) + 1):
                run = tuple(x for _, x in lines[p:e])
                if sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in run) >= least and seen.setdefault(run, (order, p)) != (order, p):
                    gone[row] |= {i for i, _ in lines[p:e]}
    return gone


def corpus(seed):
    draw = random.Random(seed)
    lines = [" ".join(f"w{draw.randrange(40)}" for _ in range(draw.choice([1, 2, 3, 4, 7, 12]))) for _ in range(14)]
    rows = [(draw.choice([None, *range(50)]) if i % 9 == 0 else 100 - i, "\n".join(draw.choice([*lines, "", " ", f"only {i} {draw.random()}"]) for _ in range(draw.randrange(1, 14)))) for i in range(60)]
    return rows + [(7, None), (8, ""), (9, "\n\n"), (1, "\n".join(lines)), (2, "\n".join(lines[3:9])), (3, "\n".join([lines[0]] * 30))]


def test_deleted_lines_equal_brute_force(spark):
    for seed, least in ((1, 10), (2, 10), (3, 25), (4, 3)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n long").coalesce(1)
        got = {r["row"]: set(r["deleted_lines"]) for r in ld.deleted_lines(docs, least, row="n").collect()}
        assert got == brute(rows, least)


def test_removed_text_and_empty_tables(spark):
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(20)) for i in range(3))
    rows = [(1, f"first\n{passage}\nend", "x"), (2, f"other\n\n{passage}\nlast", "y"), (3, None, "z"), (4, passage.replace("p0", "q"), "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")
    got = {r["doc_id"]: (r["text"], r["line"]) for r in ld.remove_repeated_runs(docs).collect()}
    assert got == {1: (rows[0][1], "x"), 2: ("other\n\nlast", "y"), 3: (None, "z"), 4: (rows[3][1], "w")}
    assert ld.remove_repeated_runs(docs.limit(0)).count() == 0 and ld.deleted_lines(docs.limit(0)).count() == 0


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b\nc d")], "doc_id long, text string")
    plan = ld.deleted_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
