"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .shared import id_and_text, mounted, shards_for, workspace
from .textkernel import LOWER, NOT_ALNUM, U, Words, groups, lists, split, text_array, window_hashes, word_hashes

#: Bytes of benchmark text that one block of the index holds.
BLOCK_BYTES = 16 << 20
BITS = 22


def alnum_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, and their hashes."""
    words = split(LOWER[data], offsets, NOT_ALNUM)
    return words, word_hashes(words)


def _windows(ids: list[str], texts: pa.Array, k: int) -> dict[str, np.ndarray]:
    """Distinct windows of some items: their word hashes (zero-padded), lengths, shingles, and items."""
    rows, lengths, owners = [], [], []
    at = 0
    for a, b, data, offsets in groups(texts):
        words, h = alnum_words(data, offsets)
        counts = words.counts
        for i in np.flatnonzero(counts):
            size = min(k, int(counts[i]))
            own = h[words.first[i] : words.first[i + 1]]
            view = np.lib.stride_tricks.sliding_window_view(own, size)
            rows.append(np.pad(view, ((0, 0), (0, k - size))))
            lengths.append(np.full(len(view), size, np.int32))
            owners.append(np.full(len(view), a + i, np.int32))
        at = b
    assert at == len(ids)
    if not rows:
        return {"words": np.zeros((0, k), np.uint64), "len": np.zeros(0, np.int32), "item_of": np.zeros(0, np.int32), "first": np.zeros(1, np.int64)}
    table = np.column_stack([np.concatenate(rows), np.concatenate(lengths).astype(np.uint64)])
    distinct, which = np.unique(table, axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack([which.ravel(), np.concatenate(owners)]), axis=0)
    return {"words": np.ascontiguousarray(distinct[:, :k]), "len": distinct[:, k].astype(np.int32), "item_of": pairs[:, 1].astype(np.int32), "first": np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))}


def _shingles(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hash of each window's two-word shingles; a window of one word has that word's hash; 0 elsewhere."""
    n, k = words.shape
    out = np.zeros((n, k), np.uint64)
    for j in range(k - 1):
        pair = window_hashes(np.ascontiguousarray(words[:, j : j + 2]).ravel(), 2)[::2]
        out[:, j] = np.where(lengths >= j + 2, pair, U(0))
    out[:, 0] = np.where(lengths == 1, words[:, 0], out[:, 0])
    return out


class Block:
    """One block of the benchmark index, mapped from the shared folder."""

    NAMES = ("words", "len", "item_of", "first", "key", "window", "offset")

    def __init__(self, folder: str):
        load = {n: np.load(f"{folder}/{n}.npy", mmap_mode="r") for n in self.NAMES}
        self.words, self.len, self.item_of, self.first, self.key, self.window, self.offset = (load[n] for n in self.NAMES)
        self.items = np.load(f"{folder}/items.npy", allow_pickle=False)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.key >> U(64 - BITS)] = True

    def match(self, words: Words, h: np.ndarray, pair: np.ndarray, pair_room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document word where a window starts, window) of every verified occurrence.

        Documents are probed only with the prefix shingle of each window. Its
        position must leave room for the whole window inside the document; then
        every word is compared.
        """
        first = np.repeat(words.first[:-1], words.counts)
        last = np.repeat(words.first[1:], words.counts)
        found = []
        for hashes, room, single in ((pair, pair_room, False), (h, np.ones(len(h), bool), True)):
            at = np.flatnonzero(self.seen[hashes >> U(64 - BITS)] & room)
            if not len(at):
                continue
            lo = np.searchsorted(self.key, hashes[at])
            n = np.searchsorted(self.key, hashes[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            if not len(at):
                continue
            entry = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            pos, window, offset = np.repeat(at, n), self.window[entry], self.offset[entry]
            size = self.len[window]
            start = pos - offset
            ok = ((size == 1) == single) & (start >= first[pos]) & (start + size <= last[pos])
            start, window, size = start[ok], window[ok], size[ok]
            for j in range(self.words.shape[1]):
                check = size > j
                same = np.ones(len(start), bool)
                same[check] = h[start[check] + j] == self.words[window[check], j]
                start, window, size = start[same], window[same], size[same]
            found.append((start, window))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_blocks: dict[str, Block] = {}


def _block(folder: str) -> Block:
    if folder not in _blocks:
        while len(_blocks) >= 4:
            _blocks.pop(next(iter(_blocks)))
        _blocks[folder] = Block(folder)
    return _blocks[folder]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", append: bool = False) -> DataFrame:
    """Where documents hold ``window`` consecutive words of benchmark items.

    An item of fewer words is one window; an item without words or identifier has
    none. The windows are joined by prefix: their two-word shingles are ordered by
    how often they occur in all documents, and since a whole window must be
    contained, its rarest shingle is a sufficient prefix. Windows with a shingle
    that no document holds are dropped. A document position with a prefix shingle
    must leave room for the window before and after it, and then all its words are
    compared. The index lies in the shared folder in blocks of ``BLOCK_BYTES``
    that workers map, so neither side is shuffled or broadcast and a passage that
    many documents share is no hot key.

    Null text has no words. Repeated items count once by identifier. Empty tables
    give no hits.

    Returns doc_id, n_words, n_hit, items (array<string>, sorted), spans
    (array<int>: begin and end, in words, of each maximal hit stretch); with
    ``append`` the columns of ``docs`` instead of doc_id, where columns with the
    other names are replaced.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    folder = mounted(workspace(spark, "benchmark"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES) or 1
    folders, made = [], []
    for b in range(n_blocks):
        rows = (items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b)).orderBy("item").toArrow()
        names = rows.column("item").to_pylist()
        index = _windows(names, text_array(rows.column("text")), window)
        here = f"{folder}/{b}"
        os.makedirs(here, exist_ok=True)
        np.save(f"{here}/items.npy", np.array(names or [""]))
        shingles = _shingles(index["words"], index["len"])
        np.save(f"{here}/shingles.npy", np.unique(shingles[shingles != 0]))
        folders.append(here)
        made.append((index, shingles))
        if n_blocks > 1:
            np.savez(f"{here}/made.npz", shingles=shingles, **index)
            made[-1] = None

    shards = shards_for(texts, 64 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = runs.RunMaker(shards, ["sum"])
        known = [np.load(f"{f}/shingles.npy", mmap_mode="r") for f in folders]
        seen = np.zeros(1 << BITS, bool)
        for x in known:
            seen[x >> U(64 - BITS)] = True
        for batch in batches:
            for _, _, data, offsets in groups(text_array(batch.column("text"))):
                words, h = alnum_words(data, offsets)
                pair = window_hashes(h, 2)
                for hashes in (pair[words.room(2)[:-1]] if len(h) > 1 else pair, h):
                    hashes = hashes[seen[hashes >> U(64 - BITS)]]
                    for x in known:
                        if len(x) and len(hashes):
                            at = np.searchsorted(x, hashes)
                            at[at == len(x)] = 0
                            hit = hashes[x[at] == hashes]
                            yield from out.add(hit, np.ones(len(hit), np.int64))
        yield from out.flush()

    rarity, _ = runs.build(texts.select("text").mapInArrow(count, runs.RUN_SCHEMA), f"{folder}/rarity", shards, ["sum"])
    for here, parts in zip(folders, made, strict=True):
        if parts is None:
            saved = np.load(f"{here}/made.npz")
            parts = {n: saved[n] for n in saved.files if n != "shingles"}, saved["shingles"]
        index, shingles = parts
        flat, where = np.unique(shingles, return_inverse=True)
        df = rarity.lookup(flat)[1][0]
        df[flat == 0] = 1 << 62
        df = df[where.reshape(shingles.shape)]
        order = np.lexsort((shingles, df), axis=1)[:, 0] if len(df) else np.zeros(0, np.int64)
        live = np.flatnonzero(df[np.arange(len(df)), order] > 0) if len(df) else order
        key = shingles[live, order[live]]
        by = np.argsort(key, kind="stable")
        for name, x in {**index, "key": key[by], "window": live[by], "offset": order[live][by]}.items():
            np.save(f"{here}/{name}.npy", x)

    added = ["n_words", "n_hit", "items", "spans"]
    source, column = (docs.drop(*added), text_col) if append else (texts, "text")
    kept = source.columns if append else ["doc_id"]
    out_schema = source.select(kept).selectExpr("*", "0L AS n_words", "0L AS n_hit", "cast(array() AS array<string>) AS items", "cast(array() AS array<int>) AS spans").schema

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in groups(text_array(batch.column(column))):
                part = batch.slice(a, b - a)
                words, h = alnum_words(data, offsets)
                n = len(h)
                pair = np.zeros(n, np.uint64)
                if n > 1:
                    pair[:-1] = window_hashes(h, 2)
                room = words.room(2)
                doc_of = words.doc_of()
                edge, pairs = np.zeros(n + 1, np.int32), []
                for f in folders:
                    block = _block(f)
                    start, win = block.match(words, h, pair, room)
                    if len(start):
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + block.len[win], -1)
                        begin, m = block.first[win], block.first[win + 1] - block.first[win]
                        entry = np.repeat(begin - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
                        found = np.unique(np.column_stack([np.repeat(doc_of[start], m), block.item_of[entry]]), axis=0)
                        pairs += [(int(d), str(block.items[i])) for d, i in found]
                hit = np.cumsum(edge[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(hit)))
                # stretches of hit words inside each document
                prev = np.concatenate(([False], hit[:-1]))
                heads = np.zeros(n, bool)
                heads[words.first[:-1][words.counts > 0]] = True
                begin = np.flatnonzero(hit & (~prev | heads))
                tails = np.concatenate((heads[1:], [True])) if n else heads
                end = np.flatnonzero(hit & (~np.concatenate((hit[1:], [False])) | tails)) + 1
                own = doc_of[begin]
                spans = np.column_stack([begin - words.first[own], end - words.first[own]]).ravel().astype(np.int32)
                per = np.bincount(own, minlength=b - a) * 2
                lists_of: list[set[str]] = [set() for _ in range(b - a)]
                for d, item in pairs:
                    lists_of[d].add(item)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(words.counts, pa.int64()), pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()), pa.array([sorted(x) for x in lists_of], pa.list_(pa.string())), lists(spans, per, pa.int32())],
                    [*kept, *added],
                )

    return source.mapInArrow(match, out_schema)
