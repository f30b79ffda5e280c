"""Packing: best fit against a plain search, and an exact round trip."""

import random

import numpy as np
import pytest

from strandfold.llm import packing as pk


def plain_best_fit(lengths, length):
    space, rows = [], []
    for n in lengths:
        fitting = [(s, -r) for r, s in enumerate(space) if s >= n]
        row = -min(fitting)[1] if fitting else len(space)
        if not fitting:
            space.append(length)
        space[row] -= n
        rows.append(row)
    return space, rows


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    draw = random.Random(seed)
    length = draw.choice([7, 64, 100])
    sizes = sorted((draw.randint(1, length) for _ in range(400)), reverse=True)
    rows = pk.best_fit_decreasing(sizes, length)
    space = [length] * (max(rows) + 1)
    for n, r in zip(sizes, rows, strict=True):
        space[r] -= n
    assert min(space) >= 0
    # Rows of equal space are alike, so the free spaces must be those of the plain search.
    assert sorted(space) == sorted(plain_best_fit(sizes, length)[0])


def test_round_trip(spark, tmp_path):
    texts = ["Hello, world! It's  a   test\n\n with\ttabs ", "", None, "é ñ 漢字 🙂" * 40, "x" * 3000, " leading", "same", "same", "word " * 900]
    docs = spark.createDataFrame([(i if i != 6 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int").repartition(3)
    rows, parts, vocabulary = pk.pack(docs, length=128, pool_bytes=2000).collect(), {}, pk.read_vocabulary()
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u2")
        assert len(ids) == 128 and r["cu_seqlens"][-1] == r["n_tokens"] <= 128 and (ids[r["n_tokens"] :] == pk.PAD).all()
        assert r["position_resets"] == r["cu_seqlens"][:-1]
        for d, p, a, b in zip(r["doc_ids"], r["parts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            parts.setdefault(d, {})[p] = ids[a:b]
    assert len({(r["pool"], r["row"]) for r in rows}) == len(rows)
    for i, t in enumerate(texts):
        own = parts.get(i if i != 6 else None, {})
        assert sorted(own) == list(range(len(own)))
        ids = np.concatenate([own[p] for p in sorted(own)]) if own else np.zeros(0, dtype="<u2")
        assert pk.decode(ids, vocabulary) == (t or "")
        assert all(len(own[p]) == 128 for p in list(own)[:-1] if p < len(own) - 1)
    pk.write_packed(docs, str(tmp_path / "packed"), length=128)
    for r in pk.read_matrix(spark, str(tmp_path / "packed")).collect():
        ids = np.frombuffer(r["ids"], dtype="<u2")[: r["n_tokens"]]
        assert r["input_ids"] == ids.tolist()
        assert r["position_ids"] == [i - max(s for s in r["position_resets"] if s <= i) for i in range(r["n_tokens"])]
    assert pk.pack(docs.limit(0)).count() == 0


def test_chunks_give_the_vocabulary_s_own_ids():
    vocabulary = pk.read_vocabulary()
    own, whole = pk.Encoder(vocabulary), pk._encoder(vocabulary)
    for text in ["a  b", "a   b\n\n c", "it's we'll  don't", "\n x\t\ty ", "tail  ", "1,234.5 %%% ¿qué?", " \n b"]:
        assert own.encode(text).tolist() == whole.encode_ordinary(text)


@pytest.mark.parametrize("blank", [" ", "\n", "\u00a0", " \n\t", "\x1c"])
def test_long_white_space(blank):
    vocabulary = pk.read_vocabulary()
    encoder = pk.Encoder(vocabulary)
    for a, b in (("a", "b"), ("", "b"), ("a", ""), ("a", "\nb")):
        short = a + blank * 90 + b
        assert encoder.encode(short).tolist() == pk._encoder(vocabulary).encode_ordinary(short)
    text = "a" + blank * 1_000_000 + "b"
    assert pk.decode(encoder.encode(text), vocabulary) == text


def test_the_cache_is_bounded_in_bytes():
    encoder = pk.Encoder(pk.read_vocabulary())
    encoder.encode(" ".join(f"x{i}" for i in range(200_000)) + " " + "y" * 100_000)
    assert encoder.held <= pk.CACHE_BYTES and all(len(k) <= pk.LONG_CHUNK for k in encoder.known)


def test_a_text_is_encoded_at_once_and_long_ones_in_pieces(monkeypatch):
    # Before, every word went to the vocabulary by itself.
    vocabulary = pk.read_vocabulary()
    encoder, whole = pk.Encoder(vocabulary), pk._encoder(vocabulary)

    class Counted:
        calls, _core_bpe = 0, whole._core_bpe

        def encode_ordinary(self, text):
            self.calls += 1
            return whole.encode_ordinary(text)

    encoder.encoding = counted = Counted()
    words = [f"{'\n' * (i % 4)}w{i}{' ' * (i % 3)},\x1c it's {i * i}" for i in range(3000)]
    text = " ".join(words) + "  "
    assert encoder.encode(text).tolist() == whole.encode_ordinary(text) and counted.calls <= 3
    monkeypatch.setattr(pk, "PIECE", 100)
    assert encoder.encode(text).tolist() == whole.encode_ordinary(text) and counted.calls > 100
    parts = [p for p, _ in pk._pieces(text + " " * 200 + "end")]
    assert "".join(parts) == text + " " * 200 + "end" and max(map(len, parts)) <= 250
