"""Vectorised word splitting and hashing over the buffers of Arrow string batches.

Every function works on whole texts. A batch is cut into groups of documents of
about ``GROUP`` bytes so that temporary arrays stay small whatever the batch
holds; one document larger than that forms a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP = 1 << 20
BLOCK = 1 << 19
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: [\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z has been lower-cased
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` makes ``x`` of."""
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9), (30, 1)):
        # the shifted parts are undone from the leading bits on
        x = x ^ (x >> U(shift)) ^ (x >> U(2 * shift) if 2 * shift < 64 else U(0))
        x = x * U(pow(factor, -1, 1 << 64))
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
BASE = 0x2545F4914F6CDD1D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 4096)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


@dataclass
class Words:
    """The words of a group of documents: byte positions, and where each document's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # document i has the words first[i]:first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self, k: int) -> np.ndarray:
        """True where k consecutive words of one document begin."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))
        return left >= k


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def groups(texts: pa.Array, limit: int = GROUP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of groups of whole documents."""
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def split(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> Words:
    """Words are maximal runs of bytes outside ``gap``; none spans two documents."""
    inside = ~gap[data]
    begin, end = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        heads, tails = offsets[:-1][full], offsets[1:][full] - 1
        begin[heads] = inside[heads]
        end[tails] = inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + BLOCK, "right")))
        b = ends[j - 1]
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTE[data[a:b]] * powers(BASE, b - a), out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * powers(BASE_INVERSE, b - a + 1)[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(words.data, words.starts, words.ends)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of hashes[i:i+k] for every i with k entries from there on, in order of words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    step = 1
    for j in range(1, k):
        step = step * 0x9E3779B97F4A7C15 % (1 << 64)
        out += hashes[j : j + n] * U(step)
    return mix(out)


def binaries(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())


def lists(values: np.ndarray | pa.Array, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column: counts[i] of the values go to row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values, kind))
