"""Deduplication of content-defined chunks of lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .shared import id_and_text, shards_for, stored, workspace
from .textkernel import SPACE, U, groups, mix, span_hashes, text_array

LAST_ID = np.iinfo(np.int64).max
#: A boundary falls after a line whose rolling hash has this remainder of zero, so a chunk has about so many lines.
LINES_PER_CHUNK = 4
#: Lines that the rolling hash spans.
ROLL = 2
#: A line of more words than this is a passage by itself.
ALONE = 50


class Chunks:
    """The passages of the lines of a group of documents: content-defined chunks, pairs of lines and long lines."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, docs = data, offsets, len(offsets) - 1
        breaks = np.flatnonzero(data == 0x0A)
        # every document has one line more than it has line breaks; an empty text has no line
        lines = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + (offsets[1:] > offsets[:-1])
        self.lines = lines
        full = offsets[1:] > offsets[:-1]
        starts = np.sort(np.concatenate((offsets[:-1][full], breaks + 1)), kind="stable")
        ends = np.sort(np.concatenate((breaks, offsets[1:][full])), kind="stable")
        n = len(starts)
        doc = np.repeat(np.arange(docs), lines)
        self.starts, self.ends, self.of = starts, ends, doc
        self.first = first = np.concatenate(([0], np.cumsum(lines)))
        h = span_hashes(data, starts, ends)
        rolled = h.copy()
        inside = np.arange(n) - first[:-1][doc]
        for k in range(1, ROLL):
            back = np.concatenate((np.zeros(k, np.uint64), h[:-k]))[:n] * U(0x9E3779B97F4A7C15 + 2 * k)
            rolled += np.where(inside >= k, back, U(0))
        cut = mix(rolled) % U(LINES_PER_CHUNK) == 0
        cut[first[1:][lines > 0] - 1] = True
        last = np.flatnonzero(cut)
        head = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
        begins = ~SPACE[data]
        inked = np.concatenate(([0], np.cumsum(begins)))
        begins[1:] &= SPACE[data[:-1]]
        at = starts[starts < len(data)]
        begins[at] = ~SPACE[data[at]]
        words = np.concatenate(([0], np.cumsum(begins)))
        solid = np.concatenate(([0], np.cumsum(inked[ends] > inked[starts])))
        #: chunks of at least two lines that aren't blank
        multi = solid[last + 1] - solid[head] >= 2
        filled = np.flatnonzero(inked[ends] > inked[starts])
        pair = np.flatnonzero(doc[filled[1:]] == doc[filled[:-1]])
        long = np.flatnonzero(words[ends] - words[starts] > ALONE)
        # no two spans of one of these overlap
        scales = [(head[multi], last[multi]), *((filled[k], filled[k + 1]) for k in (pair[pair % 2 == 0], pair[pair % 2 == 1])), (long, long)]
        keys = [span_hashes(data, starts[x], ends[y]) for x, y in scales]
        head, last = (np.concatenate(x) for x in zip(*scales, strict=True))
        _, one = np.unique(head * (n + 1) + last, return_index=True)
        self.head, self.last, self.key = head[one], last[one], np.concatenate(keys)[one]
        self.doc = doc[self.head]

    def text(self, i: int) -> bytes:
        return self.data[self.starts[self.head[i]] : self.ends[self.last[i]]].tobytes()

    def covered(self, spans: np.ndarray) -> np.ndarray:
        """The lines that lie in one of the passages that ``spans`` marks."""
        n = len(self.starts)
        return np.cumsum(np.bincount(self.head[spans], minlength=n + 1) - np.bincount(self.last[spans] + 1, minlength=n + 1))[:n] > 0

    def without(self, gone: np.ndarray) -> list[bytes]:
        """Each document's text without the lines that ``gone`` marks; the rest is joined by line breaks."""
        out = [self.data[a:b].tobytes() for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]
        for d in np.unique(self.of[gone]):
            mine = self.first[d] + np.flatnonzero(~gone[self.first[d] : self.first[d + 1]])
            out[d] = b"\n".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in mine)
        return out


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove passages of lines that occur elsewhere before.

    Lines end at ``\\n``. A hash rolling over the hashes of ``ROLL`` lines puts a
    chunk's end after a line where it is divisible by ``LINES_PER_CHUNK``, and
    after a document's last line. The boundaries hang on the lines around them
    alone, so the same passage gets the same inner chunks wherever it stands. As a
    short passage seldom holds a whole chunk, there are two smaller scales: every
    pair of successive lines that aren't blank, with the blank ones between, and
    every line of more than ``ALONE`` words. A chunk with at least two lines that
    aren't blank, a pair or a long line is removed if an equal one occurs before:
    in a document with a smaller identifier, or higher up in the same document,
    without overlap. So of a repeated passage of two or more lines that aren't
    blank all of these go, whatever surrounds it. Passages may overlap: a line goes
    if any of its passages does, and of each line the first occurrence stays.
    Equal hashes propose passages; their bytes are then compared, each distinct
    text once. Should different passages share a hash, each is told apart by its
    bytes and has its own first occurrence.

    Only packed runs and the texts of repeated chunks, once a task, are shuffled,
    so a passage that a third of all documents hold is no hot key.

    Null text stays null and an empty text has no lines; a null identifier comes
    after all others; rows with one identifier count as one document, so all of
    them keep its first occurrence of a chunk. Columns named n_lines or n_removed
    are replaced; all others are passed on.

    Returns the columns of ``docs`` with the text that is left, and n_lines and
    n_removed (lines).
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    space, shards = workspace(spark, "lines"), shards_for(texts, 32 << 20)

    def scan(batches: Iterator[pa.RecordBatch], ids: str, text: str) -> Iterator[tuple]:
        for batch in batches:
            own = batch.column(ids).cast(pa.int64()).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in groups(text_array(batch.column(text))):
                yield batch, a, b, own[a:b], Chunks(data, offsets)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = runs.RunMaker(shards, ["min", "sum"])
        for _, _, _, own, c in scan(batches, "doc_id", "text"):
            yield from out.add(c.key, own[c.doc], np.ones(len(c.key), np.int64))
        yield from out.flush()

    repeated, _ = runs.build(texts.mapInArrow(propose, runs.RUN_SCHEMA), f"{space}/proposed", shards, ["min", "sum"], keep=lambda k, first, n: (n > 1, [first]), width=1)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: dict[tuple[int, bytes], int] = {}
        size = 0

        def tell() -> pa.RecordBatch:
            return pa.record_batch([pa.array([k for k, _ in said], pa.int64()), pa.array([t for _, t in said], pa.binary()), pa.array(list(said.values()), pa.int64())], names=["key", "chunk", "first"])

        for _, _, _, own, c in scan(batches, "doc_id", "text"):
            which = np.flatnonzero(repeated.lookup(c.key, [])[0])
            for i, k, d in zip(which, c.key[which].view(np.int64).tolist(), own[c.doc[which]].tolist(), strict=True):
                at = (k, c.text(i))
                if at not in said:
                    size += len(at[1]) + 200
                said[at] = min(d, said.get(at, d))
            if size > 16 << 20:
                yield tell()
                said.clear()
                size = 0
        yield tell()

    # equality of the grouping key compares whole chunks
    distinct = texts.mapInArrow(candidates, "key bigint, chunk binary, first bigint").groupBy("key", "chunk").agg(F.min("first").alias("first"))
    distinct = stored(distinct.select("key", F.sha2("chunk", 256).alias("digest"), "first"), f"{space}/distinct")
    # different chunks under one hash, as good as none
    shared = distinct.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    clash: dict[int, dict[str, int]] = {}
    for r in distinct.join(shared, "key", "left_semi").toLocalIterator():
        clash.setdefault(r["key"], {})[r["digest"]] = r["first"]

    source = docs.drop("n_lines", "n_removed")
    schema = source.withColumn("n_lines", F.lit(0).cast("long")).withColumn("n_removed", F.lit(0).cast("long")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, own, c in scan(batches, id_col, text_col):
            found, (first,) = repeated.lookup(c.key)
            which, first = np.flatnonzero(found), first[found]
            if clash:
                for i, k in enumerate(c.key[which].view(np.int64).tolist()):
                    if k in clash:
                        first[i] = clash[k][hashlib.sha256(c.text(which[i])).hexdigest()]
            gone = np.zeros(len(c.key), bool)
            gone[which[first < own[c.doc[which]]]] = True
            # further occurrences inside the first document
            mine = which[first == own[c.doc[which]]]
            if len(mine):
                by = mine[np.lexsort((c.head[mine], c.key[mine], c.doc[mine]))]
                again = np.concatenate(([False], (c.key[by][1:] == c.key[by][:-1]) & (c.doc[by][1:] == c.doc[by][:-1])))
                stands: dict[bytes, int] = {}
                for i in np.flatnonzero(again):
                    if not again[i - 1]:
                        stands = {c.text(by[i - 1]): c.last[by[i - 1]]}
                    gone[by[i]] = c.head[by[i]] > stands.setdefault(c.text(by[i]), c.last[by[i]])
            away = c.covered(gone)
            part = batch.slice(a, b - a)
            at = part.schema.names.index(text_col)
            left = pa.array(c.without(away), pa.binary()).cast(part.schema.field(at).type)
            if part.column(at).null_count:
                left = pc.if_else(part.column(at).is_null(), pa.scalar(None, left.type), left)
            columns = [*part.columns[:at], left, *part.columns[at + 1 :], pa.array(c.lines, pa.int64()), pa.array(np.bincount(c.of, weights=away, minlength=b - a).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "n_lines", "n_removed"])

    return source.mapInArrow(cut, schema)
