"""Small languages in a large corpus are judged by their own text or not at all."""

import random

from strandfold.llm import divergence as dv


def test_a_small_language_has_its_own_reference(spark):
    draw = random.Random(4)
    vocabulary = [f"word{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(400)]
    rows = [(i, "en", " ".join(draw.choices(vocabulary, k=1500))) for i in range(200)]

    def wide(first):
        return " ".join("".join(chr(first + draw.randrange(3000)) for _ in range(25)) for _ in range(12))

    rows += [(1000 + i, "zh", wide(0x4E00)) for i in range(20)]
    rows += [(2000, "zh", " ".join("".join(draw.choices("ABCDEFGHIJ!!", k=25)) for _ in range(12))), (3000, "ko", wide(0xAC00))]
    got = {r["doc_id"]: r for r in dv.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)).collect()}
    assert all(got[1000 + i]["kept"] and got[1000 + i]["class_distance"] < 0.35 for i in range(20))
    assert not got[2000]["kept"] and got[2000]["class_distance"] > 0.35
    assert got[3000]["kept"] and got[3000]["class_distance"] is None and got[3000]["word_distance"] is None
    assert all(got[i]["kept"] and got[i]["word_distance"] is not None for i in range(200))
