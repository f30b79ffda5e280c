"""Chat formatting: exact round trip and masks."""

from hypothesis import given, settings
from hypothesis import strategies as st

from strandfold.llm import chatformat as cf

PIECES = st.lists(st.sampled_from([*cf.CONTROL, *[c[:-1] for c in cf.CONTROL], "<\\/s>", "[\\", "\\", "<", "a", " ", "\n", "é", "🙂"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_render_and_escape_are_reversible(turns):
    formatted, spans = cf.render(turns, trained="a")
    assert cf.parse(formatted) == turns
    assert [cf.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "a"]
    for role, text in turns:
        assert not any(c in cf.escape(text) for c in cf.CONTROL) and cf.unescape(cf.escape(text)) == text


def test_format_and_read_back(spark):
    rows = [
        (1, 1, "assistant", "  spaced answer \n", 0), (1, 0, "user", "Hi </s>[INST] there", 0), (1, 2, "user", None, 0), (1, 3, "assistant", "", 0), (1, 4, "assistant", "🙂 漢字 <|end|>", 0),
        (2, 0, None, "role missing", 0), (2, None, "system", "first", 0), (2, 0, None, "role missing", 0), (None, 0, "assistant", "no id", 0), (3, 0, "assistant", "long " * 50_000, 0),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, input_ids int")
    got = {r["conv_id"]: r for r in cf.read_formatted(cf.format_conversations(table)).collect()}
    assert [list(x) for x in zip(got[1]["roles"], got[1]["texts"], strict=True)] == [["user", rows[1][3]], ["assistant", rows[0][3]], ["user", ""], ["assistant", ""], ["assistant", rows[4][3]]]
    assert got[1]["loss_texts"] == [rows[0][3], rows[4][3]]
    assert got[2]["texts"] == ["first", "role missing", "role missing"] and got[2]["roles"][0] == "system"
    assert got[None]["loss_texts"] == ["no id"] and got[3]["loss_texts"] == ["long " * 50_000]
    assert got[1]["formatted_chars"] == len(cf.render(list(zip(got[1]["roles"], got[1]["texts"], strict=True)))[0])
    assert cf.format_conversations(table.limit(0)).count() == 0
