"""Sorted runs of 64-bit keys, and tables of them that workers map into memory.

A map task turns what it has read into sorted runs, one per shard (the leading
bits of the key), with equal keys already reduced. A run travels as one packed
binary, so a shuffle moves a few bytes a key and no JVM row for each. A reducer
merges the runs of one shard and writes them as sorted arrays into the shared
folder. A key that a third of all rows share costs one entry in each run.

With more than ``SPREAD`` shards, runs are merged in two levels: a map task makes
one run for each of ``SPREAD`` ranges of shards; then the runs of one range and
some of the map tasks are merged, and parted by shard. So a map task never makes
more than ``SPREAD`` runs a flush, and a shard's reducer reads no more than
shards / ``SPREAD`` of them.
"""

from __future__ import annotations

import json
import mmap
import os
import struct
import sys
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mounted

RUN_SCHEMA = "shard int, run binary"
_ARROW = pa.schema([("shard", pa.int32()), ("run", pa.binary())])
#: Entries that a map task gathers before it emits runs.
FLUSH = 3_000_000
#: Runs that a map task makes a flush at the most, a power of two.
SPREAD = 512
REDUCE = {"sum": np.add, "min": np.minimum, "max": np.maximum}


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(raw: memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel()


def pack(keys: np.ndarray, columns: Sequence[np.ndarray]) -> bytes:
    """Sorted keys as differences, and non-negative columns, in compressed byte planes."""
    n = len(keys)
    body = _planes(np.diff(keys, prepend=np.uint64(0))) + b"".join(_planes(c.astype(np.uint64)) for c in columns)
    return struct.pack("<qi", n, len(columns)) + pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)


def unpack(run: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    n, m = struct.unpack_from("<qi", run)
    body = memoryview(pa.Codec("zstd").decompress(memoryview(run)[12:], n * 8 * (m + 1), asbytes=True))
    keys = np.cumsum(_values(body[: 8 * n], n), dtype=np.uint64)
    return keys, [_values(body[8 * n * (i + 1) : 8 * n * (i + 2)], n).astype(np.int64) for i in range(m)]


def reduce_sorted(keys: np.ndarray, columns: Sequence[np.ndarray], how: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sort by key and reduce each column over equal keys; ``with`` takes the least value beside the least of the first column."""
    if not len(keys):
        return keys, list(columns)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    out: list[np.ndarray] = []
    for c, h in zip(columns, how, strict=True):
        if h == "with":
            least = columns[0][order] == np.repeat(out[0], np.diff(np.append(first, len(keys))))
            out.append(np.minimum.reduceat(np.where(least, c[order], np.iinfo(np.int64).max), first))
        else:
            out.append(REDUCE[h].reduceat(c[order], first))
    return keys[first], out


def parted(keys: np.ndarray, cols: Sequence[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted entries as one packed run for each value of the keys' leading bits."""
    which = keys >> np.uint64(64 - bits)
    heads = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(heads, np.append(heads[1:], len(keys)), strict=True):
        yield pa.record_batch([pa.array([int(which[a])], pa.int32()), pa.array([pack(keys[a:b], [c[a:b] for c in cols])], pa.binary())], schema=_ARROW)


def merged(runs: pa.ChunkedArray, how: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The entries of packed runs, reduced."""
    parts = [unpack(x.as_py()) for x in runs.combine_chunks()]
    return reduce_sorted(np.concatenate([p[0] for p in parts]), [np.concatenate([p[1][i] for p in parts]) for i in range(len(how))], how)


class RunMaker:
    """Gathers keys and columns of a map task; gives record batches of packed runs."""

    def __init__(self, shards: int, how: Sequence[str], spread: int = SPREAD):
        self.bits, self.how = min(shards, spread).bit_length() - 1, list(how)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, keys: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, cols = reduce_sorted(keys, columns, self.how)
        self.parts.append((keys, *cols))
        self.size += len(keys)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            joined = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.parts, self.size = [], 0
            keys, cols = reduce_sorted(joined[0], joined[1:], self.how)
            del joined
            yield from parted(keys, cols, self.bits)


def _plain(keys: np.ndarray, cols: Sequence[np.ndarray]) -> dict[str, np.ndarray]:
    return {"0": keys} | {str(i): x if len(x) and x.max() >= 1 << 31 else x.astype(np.int32) for i, x in enumerate(cols, 1)}


def write(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Named arrays in one file, each at a multiple of eight bytes, after a line that lists them."""
    listed = json.dumps([(name, x.dtype.str, len(x)) for name, x in arrays.items()]).encode()
    with open(path, "wb") as out:
        out.write(listed + b" " * (-(len(listed) + 1) % 8) + b"\n")
        for x in arrays.values():
            out.write(np.ascontiguousarray(x).view(np.uint8).data)
            out.write(bytes(-x.nbytes % 8))


def build(runs: DataFrame, path: str, shards: int, how: Sequence[str], keep: Callable | None = None, summary: Callable | None = None, n_sums: int = 0, width: int | None = None, spread: int = SPREAD, arrays: Callable | None = None) -> tuple[Store, list[float]]:
    """Merge the runs of each shard and write its sorted arrays below ``path``.

    ``keep(keys, *columns)`` gives a mask of the entries to store, or a tuple of
    mask and the ``width`` columns to store; ``summary(keys, *columns)`` gives ``n_sums`` numbers,
    taken over all merged entries, whose sums over all shards are returned. Only
    those few numbers a shard come to the driver. ``arrays(keys, columns)`` names other
    arrays to write instead. Files get their final name at the end, so a task that
    runs again leaves the same table.
    """
    folder = mounted(path)
    os.makedirs(folder, exist_ok=True)
    how = list(how)

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, cols = merged(table.column("run"), how)
        sums = [float(x) for x in summary(keys, *cols)] if summary else []
        if keep:
            mask = keep(keys, *cols)
            mask, cols = mask if isinstance(mask, tuple) else (mask, cols)
            keys, cols = keys[mask], [c[mask] for c in cols]
        part = f"{folder}/.{uuid.uuid4().hex}"
        write(part, (arrays or _plain)(keys, cols))
        os.replace(part, f"{folder}/{shard}")
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "sums": pa.array([sums], pa.list_(pa.float64()))})

    if shards > spread:
        bits = shards.bit_length() - 1

        def part(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches(parted(*merged(table.column("run"), how), bits), _ARROW)

        some = F.pmod(F.hash(F.spark_partition_id()), F.lit(shards // spread)).alias("some")
        runs = runs.select("shard", "run", some).groupBy("shard", "some").applyInArrow(part, RUN_SCHEMA)
    rows = runs.groupBy("shard").applyInArrow(merge, "shard int, n bigint, sums array<double>").collect()
    total = [sum(r["sums"][i] for r in rows) for i in range(n_sums)]
    return Store(folder, shards, width if width is not None else len(how), {r["shard"]: r["n"] for r in rows if r["n"]}), total


#: Whether a file can be mapped without staying open.
UNTRACKED = sys.version_info >= (3, 13)
#: Shards that a worker has mapped at once, of all its tables; the one used longest ago makes room. Systems
#: allow a process about 65,000 maps, but often no more than 1,024 open files.
MAPPED = 16_384 if UNTRACKED else 600
_mapped: OrderedDict[tuple[str, int], dict[str, np.ndarray]] = OrderedDict()


def mapped(folder: str, shard: int) -> dict[str, np.ndarray]:
    """The arrays of a shard, mapped into memory, where possible without keeping a file open."""
    at = (folder, shard)
    if at in _mapped:
        _mapped.move_to_end(at)
        return _mapped[at]
    with open(f"{folder}/{shard}", "rb") as f:
        listed = f.readline()
        whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if UNTRACKED else {}))
    out, begin = {}, len(listed)
    for name, dtype, n in json.loads(listed):
        out[name] = np.frombuffer(whole, dtype, n, begin) if n else np.empty(0, dtype)
        begin += -(-out[name].nbytes // 8) * 8
    _mapped[at] = out
    while len(_mapped) > MAPPED:
        _mapped.popitem(last=False)
    return out


class Store:
    """Sorted arrays in the shared folder. Pickled, it is a path and the shard numbers."""

    def __init__(self, folder: str, shards: int, width: int, sizes: dict[int, int]):
        self.folder, self.shards, self.width, self.full, self.size = folder, shards, width, frozenset(sizes), sum(sizes.values())
        # how many entries stand in the shards before
        self.before, n = {}, 0
        for shard in sorted(sizes):
            self.before[shard] = n
            n += sizes[shard]

    def column(self, shard: int, i: int) -> np.ndarray:
        return mapped(self.folder, shard)[str(i)]

    def lookup(self, keys: np.ndarray, columns: Sequence[int] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each key is stored, and its columns (0 where it isn't); column -1 is its place among all keys.

        Sorted keys are read fastest.
        """
        columns = range(self.width) if columns is None else columns
        order = None
        if len(keys) > 1 and not bool((keys[1:] >= keys[:-1]).all()):
            order = np.argsort(keys)
            keys = keys[order]
        found, out = np.zeros(len(keys), bool), [np.zeros(len(keys), np.int64) for _ in columns]
        bits = np.uint64(65 - self.shards.bit_length())
        cut = np.searchsorted(keys >> bits, np.arange(self.shards + 1, dtype=np.uint64))
        for s in self.full:
            a, b = cut[s], cut[s + 1]
            if a < b:
                have = self.column(s, 0)
                at = np.searchsorted(have, keys[a:b])
                at[at == len(have)] = 0
                hit = have[at] == keys[a:b]
                found[a:b] = hit
                for o, c in zip(out, columns, strict=True):
                    o[a:b][hit] = self.column(s, c + 1)[at[hit]] if c >= 0 else at[hit] + self.before[s]
        if order is None:
            return found, out
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return found[back], [o[back] for o in out]
