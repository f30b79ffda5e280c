"""Vectorised words against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

from strandfold.llm import words as w

TEXTS = ["", None, "one", "  two  words ", "Ärger É\tB\nC", "a b c d e f a b c d e f", "x" * 200 + " " + "x" * 199, "-- ## --", "end ", " start"]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_words_and_hashes(monkeypatch, chunk):
    monkeypatch.setattr(w, "CHUNK", chunk)
    found = w.split_words(pa.array(TEXTS), w.NOT_SPACE)
    by_hash = {}
    for d, text in enumerate(TEXTS):
        want = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        own = range(found.first[d], found.first[d + 1])
        assert [found.data[found.starts[i] : found.ends[i]].tobytes().decode() for i in own] == want
        for i, word in zip(own, want, strict=True):
            assert by_hash.setdefault(found.hashes[i], word) == word
    assert len(by_hash) == len({x for t in TEXTS for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")})


def test_alphanumeric_words_of_sliced_column():
    column = pa.array(["zero", "Don't A1-b2", "ÉCOLE école", None])[1:]
    found = w.split_words(column, w.ALPHANUMERIC, lower=True)
    got = [[found.data[s:e].tobytes().decode() for s, e in zip(found.starts[a:b], found.ends[a:b], strict=True)] for a, b in zip(found.first, found.first[1:], strict=False)]
    assert got == [["don", "t", "a1", "b2"], ["École".lower().replace("é", "É"), "école"], []]


def test_windows_depend_on_their_words_only():
    found = w.split_words(pa.array(["a b c d", "z a b c", "a b"]), w.NOT_SPACE)
    h, full = found.windows(3), found.full(3)
    assert h[0] == h[5] and h[0] != h[1]
    assert full.tolist() == [True, True, False, False, True, True, False, False, False, False]


def test_covered_and_slices():
    assert w.covered(6, np.array([1, 2]), 2).tolist() == [False, True, True, True, False, False]
    batch = pa.record_batch([pa.array(["ab" * 10, "c", None, "d" * 50])], names=["t"])
    pieces = [p.column("t").to_pylist() for p in w.slices(batch, "t", most=25)]
    assert [x for p in pieces for x in p] == batch.column("t").to_pylist()
    assert max(len(p) for p in pieces) <= 3
