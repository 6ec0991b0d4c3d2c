"""Substring deduplication by relative Lempel-Ziv parsing over the words of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .shared import id_and_text, shards_for, workspace
from .textkernel import U, Words, groups, lists, mix, split, text_array, window_hashes, word_hashes

#: Words of the seeds that choose where a block is indexed.
SEED = 5
LAST_ID = np.iinfo(np.int64).max


def _scan(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple]:
    """Of each group of documents: identifiers, words, where windows begin, each
    window's anchor (the least seed hash inside it), and the word hashes."""
    seed = min(SEED, window)
    for batch in batches:
        ids = batch.column("doc_id").fill_null(LAST_ID).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in groups(text_array(batch.column("text"))):
            words = split(data, offsets)
            h = word_hashes(words)
            seeds = window_hashes(h, seed)
            n = len(h) - window + 1
            if n > 0:
                starts = np.flatnonzero(words.room(window)[:n])
                anchor = seeds[:n].copy()
                for j in range(1, window - seed + 1):
                    np.minimum(anchor, seeds[j : j + n], out=anchor)
            else:
                starts, anchor = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            # minima are small numbers; mixed again they spread evenly over the shards
            yield batch, a, b, ids[a:b], words, h, starts, mix(anchor[starts]) if n > 0 else anchor


def _known(store: runs.Store, keys: np.ndarray, columns: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    flat, where = np.unique(keys, return_inverse=True)
    found, values = store.lookup(flat, columns)
    return found[where], [v[where] for v in values]


def _window_keys(h: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and check value, independent hashes, of the windows that begin at ``starts``."""
    key, check, step = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64), 1
    for j in range(window):
        word = h[starts + j]
        key += word * U(step)
        check = (check ^ word) * U(0xFF51AFD7ED558CCD)
        check ^= check >> U(29)
        step = step * 0x9E3779B97F4A7C15 % (1 << 64)
    return mix(key), (mix(check) >> U(33)).astype(np.int64)


def keep_words(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each document joined by one space."""
    data = words.data.copy()
    kept = np.flatnonzero(keep)
    docs = words.doc_of()[kept]
    head = np.ones(len(kept), bool)
    head[1:] = docs[1:] != docs[:-1]
    begin = words.starts[kept] - ~head
    data[begin[~head]] = 0x20
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, words.ends[kept], -1)
    take = np.cumsum(edge[:-1]) > 0
    sizes = np.bincount(docs, weights=words.ends[kept] - begin, minlength=len(words.first) - 1).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.tobytes()), pa.py_buffer(data[take].tobytes()))


def repeated_passages(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut passages of ``window`` words or more that a document with a smaller identifier holds.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. The documents of a map task are
    a reference block; a block is indexed by the hash of each of its windows, with
    the smallest identifier that holds it and the first position there. Blocks are
    indexed in two steps, so that text which occurs once costs little: first only
    anchors, the least seed hash in each window, about every fifth word; then, under
    anchors which two documents share, all windows. The runs of all blocks merge
    into sorted arrays in the shared folder. Each document is then parsed greedily
    against every block at once: at a window that an earlier document holds, a
    factor begins as a copy of that position, and it grows as long as the next
    window is a copy of the next position there; where it ends, the next factor may
    begin, also inside the reach of the last one. Every window of a factor, its
    boundaries with it, is confirmed by a second, independent hash. All windows are
    judged on the input. The parse reads text where it lies: nothing is shuffled but
    packed runs, in which a passage that very many documents share is one entry a task.

    Null text has no words; a null identifier is larger than any other; rows with
    one identifier are no earlier than each other. Other columns are ignored.

    Returns doc_id, n_words, n_removed, factors (array of structs: begin and end in
    words; source, the identifier of the document that is copied, and at, the word
    where the copy begins there), kept (the text left, its words joined by one space).
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    space, shards = workspace(spark, "passages"), shards_for(texts)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = runs.RunMaker(shards, ["min", "max"])
        for _, _, _, ids, words, _, starts, anchor in _scan(batches, window):
            if len(starts):
                # consecutive windows mostly share their anchor
                new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)))
                own = ids[words.doc_of()[starts[new]]]
                yield from out.add(anchor[new], own, own)
        yield from out.flush()

    shared, _ = runs.build(texts.mapInArrow(anchors, runs.RUN_SCHEMA), f"{space}/anchors", shards, ["min", "max"], keep=lambda k, lo, hi: (lo != hi, []), width=0)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = runs.RunMaker(shards, how)
        for _, _, _, ids, words, h, starts, anchor in _scan(batches, window):
            if len(starts):
                at = starts[_known(shared, anchor, [])[0]]
                key, check = _window_keys(h, at, window)
                doc = words.doc_of()[at]
                yield from out.add(key, ids[doc], ids[doc], check, at - words.first[doc])
        yield from out.flush()

    how = ["min", "max", "min", "with"]
    index, _ = runs.build(texts.mapInArrow(windows, runs.RUN_SCHEMA), f"{space}/windows", shards, how, keep=lambda k, lo, hi, c, p: (lo != hi, [lo, c, p]), width=3)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, ids, words, h, starts, anchor in _scan(batches, window):
            n = len(h)
            doc_of = words.doc_of()
            at, source, place = (np.zeros(0, np.int64) for _ in range(3))
            if len(starts):
                some = starts[_known(shared, anchor, [])[0]]
                key, check = _window_keys(h, some, window)
                found, (first, confirm, position) = _known(index, key, [0, 1, 2])
                hit = found & (first < ids[doc_of[some]]) & (check == confirm)
                at, source, place = some[hit], first[hit], position[hit]
            own = doc_of[at]
            # a factor grows while the next window copies the next position of the same source
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]) | (source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1)
            lead = np.flatnonzero(new)
            begin, own = at[lead], own[lead]
            end = at[np.append(lead[1:], len(at)) - 1] + window if len(at) else begin
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, begin, 1)
            np.add.at(edge, end, -1)
            gone = np.cumsum(edge[:-1]) > 0
            fields = [pa.array(begin - words.first[own], pa.int32()), pa.array(end - words.first[own], pa.int32()), pa.array(source[lead]), pa.array(place[lead], pa.int32())]
            factors = pa.StructArray.from_arrays(fields, ["begin", "end", "source", "at"])
            total = np.concatenate(([0], np.cumsum(gone)))
            yield pa.record_batch(
                [batch.column("doc_id").slice(a, b - a), pa.array(words.counts, pa.int64()), pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()), lists(factors, np.bincount(own, minlength=b - a)), keep_words(words, ~gone)],
                names=["doc_id", "n_words", "n_removed", "factors", "kept"],
            )

    return texts.mapInArrow(parse, "doc_id bigint, n_words bigint, n_removed bigint, factors array<struct<begin:int,end:int,source:bigint,at:int>>, kept string")


def digest_columns(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
