"""Words, word hashes and word windows of a whole Arrow column at once.

A text column is one byte buffer, so cutting it into words is a table look-up per byte and hashing every word is a
difference of two prefix sums. Separators are ASCII in every caller, hence bytes are enough: no UTF-8 sequence holds
an ASCII byte. Work arrays cover about a quarter of a megabyte at a time, however long a text is.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 18
LONG_WORD = 64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
WINDOW_BASE = 0xD1342543DE82EF95


def byte_table(separators: bytes) -> np.ndarray:
    """True for each byte that is part of a word."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


#: Words are runs without ASCII white space.
NOT_SPACE = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII digits, lower-case letters and anything beyond ASCII.
ALPHANUMERIC = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        found = []
        for base in (BASE, BASE_INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps, dtype=np.uint64))
        if size > CHUNK + 1:  # a word longer than a chunk; not kept
            return found[0], found[1]
        _powers[:] = found
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Word ``i`` is ``data[starts[i]:ends[i]]``; document ``d`` has the words ``first[d]:first[d + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def joined(self, a: int, b: int) -> bytes:
        """Words a to b with one space between."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True))

    def windows(self, width: int) -> np.ndarray:
        """A hash for the window that starts at each word; those past a document's last full window mean nothing."""
        n, total = len(self.hashes), np.zeros(len(self.hashes), dtype=np.uint64)
        for j in range(min(width, n)):
            total[: n - j] += self.hashes[j:] * np.uint64(pow(WINDOW_BASE, j, 1 << 64))
        return mix(total ^ np.uint64(width))

    def full(self, width: int) -> np.ndarray:
        """Whether a window of this width that starts at a word ends in the same document."""
        last = np.repeat(self.first[1:], self.counts())
        return np.arange(len(self.hashes)) + width <= last


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its texts; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(offsets: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about CHUNK bytes that end between documents or, in a longer document, between words."""
    at, total = 0, int(offsets[-1])
    while at < total:
        end = int(offsets[np.searchsorted(offsets, at + CHUNK, side="right") - 1])
        if end <= at:
            end = min(at + CHUNK, int(offsets[np.searchsorted(offsets, at, side="right")]))
            stop = int(offsets[np.searchsorted(offsets, at, side="right")])
            while end < stop and is_word[end]:
                gaps = np.flatnonzero(~is_word[end : end + CHUNK])
                end = min(stop, end + (int(gaps[0]) if len(gaps) else CHUNK))
        yield at, end
        at = end


def split_words(column: pa.Array, table: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    data, offsets = text_buffer(column)
    if lower:
        data = LOWER[data]
    all_words = table[data]
    starts, ends, hashes = [], [], []
    for a, b in _cuts(offsets, all_words):
        part, inside = data[a:b], all_words[a:b]
        edges = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[edges] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[edges[edges > 0] - 1] = False
        s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        up, down = powers(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        size = (e - s).astype(np.uint64)
        h = mix((sums[e] - sums[s]) * down[s] ^ (size * np.uint64(0xA24BAED4963EE407)))
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(part[s[i] : e[i]].tobytes())
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(h)
    whole = [np.concatenate(x) if x else np.zeros(0, dtype=kind) for x, kind in ((starts, np.int64), (ends, np.int64), (hashes, np.uint64))]
    return Words(data, offsets, *whole, np.searchsorted(whole[0], offsets))


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n words lie in a window of this width that starts at one of ``starts``."""
    change = np.zeros(n + width + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change)[:n] > 0


def give_back() -> None:
    """Return what was freed to the system: Python workers live on for other stages, beside an executor's JVM."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, text: str, most: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` text bytes, so that long texts do not add up."""
    _, offsets = text_buffer(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    give_back()
