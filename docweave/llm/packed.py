"""Tables of exact keys in a few bytes an entry, which workers map into memory.

A ``Pairing`` makes one key of two numbers whose bits are known, so a key has only
as many bits as the corpus needs. A shard drops the bits that its number and a small
index tell, and stores 32 of each key; counts take a byte, larger ones a side table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import runs
from .textkernel import U, mix

#: A count of so much or more stands in the side table.
LARGE = 255
#: Entries, about, of a bucket of a shard's index.
BUCKET = 64


@dataclass(frozen=True)
class Pairing:
    """An exact key of two numbers of ``left`` and ``right`` bits, in the leading bits of 64.

    Three rounds in which each number is changed by a hash of the other scatter the
    keys, so that neither number's entries are one shard's; they can be undone.
    """

    left: int
    right: int

    def __post_init__(self) -> None:
        if self.bits > 64:
            raise OverflowError(f"a pair of {self.left} and {self.right} bits has no 64-bit key")

    @property
    def bits(self) -> int:
        return self.left + self.right

    def _hash(self, x: np.ndarray, salt: int, bits: int) -> np.ndarray:
        return mix(x + U(salt << 56)) >> U(64 - bits)

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a = a ^ self._hash(b, 1, self.left)
        b = b ^ self._hash(a, 2, self.right)
        a = a ^ self._hash(b, 3, self.left)
        return (a << U(self.right) | b) << U(64 - self.bits)

    def pair(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two numbers of each key."""
        keys = keys >> U(64 - self.bits)
        a, b = keys >> U(self.right), keys & U((1 << self.right) - 1)
        a = a ^ self._hash(b, 3, self.left)
        b = b ^ self._hash(a, 2, self.right)
        return a ^ self._hash(b, 1, self.left), b


def _column(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    large = np.flatnonzero(values >= LARGE)
    return {name: np.minimum(values, LARGE).astype(np.uint8), f"{name}at": large, f"{name}is": values[large]}


def _index_bits(n: int, rest: int) -> int:
    """Bits of a shard's index: those that 32 don't hold, or more so that a bucket is small."""
    return min(rest, max(rest - 32, (n // BUCKET).bit_length()))


class Packed:
    """Sorted keys of ``bits`` bits and their counts in the shared folder. Pickled, it is a path and sizes."""

    def __init__(self, store: runs.Store, bits: int):
        self.store, self.bits, self.width, self.size = store, bits, store.width, store.size
        self.rest = bits - (store.shards.bit_length() - 1)
        self.full = sorted(store.full)
        self.starts = np.array([store.before[s] for s in self.full], np.int64)

    @staticmethod
    def build(made: DataFrame, path: str, shards: int, how: Sequence[str], bits: int, **more) -> tuple[Packed, list[float]]:
        rest = bits - (shards.bit_length() - 1)

        def arrays(keys: np.ndarray, cols: Sequence[np.ndarray]) -> dict[str, np.ndarray]:
            top = _index_bits(len(keys), rest)
            keys = keys >> U(64 - bits) & U((1 << rest) - 1)
            bounds = np.searchsorted(keys >> U(rest - top), np.arange((1 << top) + 1, dtype=np.uint64))
            out = {"index": bounds.astype(np.uint32), "0": (keys & U((1 << rest - top) - 1)).astype(np.uint32)}
            for i, c in enumerate(cols):
                out |= _column(str(i + 1), c)
            return out

        store, sums = runs.build(made, path, shards, how, arrays=arrays, **more)
        return Packed(store, bits), sums

    def _get(self, shard: int, name: str) -> np.ndarray:
        return runs.mapped(self.store.folder, shard)[name]

    def values(self, shard: int, i: int, at: np.ndarray | slice) -> np.ndarray:
        """A column of a shard at these places in it, which are sorted or not."""
        out = self._get(shard, str(i + 1))[at].astype(np.int64)
        large = np.flatnonzero(out == LARGE)
        if len(large):
            where = large if isinstance(at, slice) else at[large]
            out[large] = self._get(shard, f"{i + 1}is")[np.searchsorted(self._get(shard, f"{i + 1}at"), where)]
        return out

    def keys(self, shard: int, at: np.ndarray | None = None) -> np.ndarray:
        """The whole keys at these places in a shard, or all of them."""
        index, low = self._get(shard, "index"), self._get(shard, "0")
        top = (len(index) - 1).bit_length() - 1
        if at is None:
            head = np.repeat(np.arange(len(index) - 1, dtype=np.uint64), np.diff(index))
        else:
            head, low = (np.searchsorted(index, at, "right") - 1).astype(np.uint64), low[at]
        return (U(shard) << U(self.rest) | head << U(self.rest - top) | low.astype(np.uint64)) << U(64 - self.bits)

    def keys_at(self, places: np.ndarray) -> np.ndarray:
        """The keys at sorted places among all keys."""
        out = np.empty(len(places), np.uint64)
        cut = np.append(np.searchsorted(places, self.starts), len(places))
        for s, first, a, b in zip(self.full, self.starts, cut[:-1], cut[1:], strict=True):
            if a < b:
                out[a:b] = self.keys(s, places[a:b] - first)
        return out

    def lookup(self, keys: np.ndarray, columns: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of sorted keys: whether each is stored, its place among all keys, and its columns (0 where it isn't)."""
        columns = range(self.width) if columns is None else columns
        found, place = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        short = keys >> U(64 - self.bits)
        cut = np.searchsorted(short >> U(self.rest), np.arange(self.store.shards + 1, dtype=np.uint64))
        for s, first in zip(self.full, self.starts, strict=True):
            a, b = cut[s], cut[s + 1]
            if a == b:
                continue
            index, low = self._get(s, "index"), self._get(s, "0")
            shift = self.rest - ((len(index) - 1).bit_length() - 1)
            own = short[a:b] & U((1 << self.rest) - 1)
            head, want = (own >> U(shift)).astype(np.int64), (own & U((1 << shift) - 1)).astype(np.uint32)
            at, end = index.take(head).astype(np.int64), index.take(head + 1).astype(np.int64)
            step = 1 << int((end - at).max()).bit_length() >> 1
            while step:
                # a step is taken where the last entry passed by it is smaller
                after = at + step
                ok = after <= end
                ok &= low.take(after - 1, mode="clip") < want
                at += ok * step
                step >>= 1
            hit = (at < end) & (low.take(at, mode="clip") == want)
            found[a:b], at = hit, at[hit]
            place[a:b][hit] = at + first
            for i, o in zip(columns, out, strict=True):
                o[a:b][hit] = self.values(s, i, at)
        return found, place, out


class Dense:
    """Counts by place, for places from 0 on of which nearly each has some: no key is stored."""

    def __init__(self, store: runs.Store, bits: int):
        self.store, self.width = store, store.width
        self.rest = bits - (store.shards.bit_length() - 1)
        self.full = sorted(store.full)

    @staticmethod
    def build(made: DataFrame, path: str, shards: int, how: Sequence[str], bits: int) -> Dense:
        rest = bits - (shards.bit_length() - 1)

        def arrays(keys: np.ndarray, cols: Sequence[np.ndarray]) -> dict[str, np.ndarray]:
            at = (keys >> U(64 - bits) & U((1 << rest) - 1)).astype(np.int64)
            out = {}
            for i, c in enumerate(cols):
                whole = np.zeros(int(at[-1]) + 1 if len(at) else 0, np.int64)
                whole[at] = c
                out |= _column(str(i + 1), whole)
            return out

        return Dense(runs.build(made, path, shards, how, arrays=arrays)[0], bits)

    values, _get = Packed.values, Packed._get

    def at(self, places: np.ndarray) -> list[np.ndarray]:
        """The columns at sorted places; 0 where there are none."""
        out = [np.zeros(len(places), np.int64) for _ in range(self.width)]
        for s in self.full:
            a, b = np.searchsorted(places, [s << self.rest, (s + 1) << self.rest])
            if a < b:
                own = places[a:b] - (s << self.rest)
                own = own[own < len(self._get(s, "1"))]
                for i, o in enumerate(out):
                    o[a : a + len(own)] = self.values(s, i, own)
        return out
