"""Byte-level BPE encoding and decoding with forced-boundary splitting."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import groups, lists, text_array

#: The word splitting of byte-level BPE, as its published description has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PIECES = regex.compile(PATTERN)
#: Fragments up to so many bytes are remembered and merged by plain lists, and how many are remembered before a worker starts anew.
SHORT, REMEMBERED = 48, 1 << 18
#: Bytes of ids that a worker has in hand at once while it decodes.
GROUP = 1 << 20
#: Kinds of characters that the word splitting tells apart.
LETTER, NUMBER, WHITE, OTHER = range(4)
APOSTROPHE = 0x27


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary's spelling."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return out


def character_kinds() -> np.ndarray:
    """The kind of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000)))
    every = "".join(map(chr, points.tolist()))
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(name, every):
            out[points[m.start() : m.end()]] = kind
    return out


class Codec:
    """Encoder and decoder for one vocabulary file.

    Two neighbouring bytes that stand inside no token can never end up in one
    token, as each merge makes a token: between them is a certain cut. A text is
    cut at every such place where the word splitting, too, does the same on both
    sides whether or not it sees the other: after white space it doesn't, nor
    around an apostrophe that may begin a contraction. The fragments, mostly a word
    with the space before it, are encoded independently by merging, each distinct
    one once for as long as it is remembered, and their ids are put together.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = byte_alphabet(), spec["model"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        self.token = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in vocab.items():
            self.token[i] = raw(t)
        for t, i in special.items():
            self.token[i] = t.encode()
        self.single = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        # the rank of each pair that merges, and what the merge of each rank makes
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), rank)
            self.made.append(vocab[a + b])
        self.inside = np.zeros((256, 256), bool)
        for t in vocab:
            b = np.frombuffer(raw(t), np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.kind = character_kinds()
        self.special = {t.encode(): i for t, i in special.items()}
        self.find_special = regex.compile(b"|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if special else None
        self.known: dict[bytes, tuple[int, ...]] = {}

    def kinds(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each byte, the kind of its character, and whether it is the character's first."""
        if not len(data) or int(data.max()) < 0x80:
            return self.kind[data], np.ones(len(data), bool)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        head = np.zeros(len(data), bool)
        head[np.cumsum(size) - size] = True
        return np.repeat(self.kind[points], size), head

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Every certain cut of the UTF-8 bytes ``data`` that the word splitting allows."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        kind, head = self.kinds(data)
        left, right, mark = kind[:-1], kind[1:], data == APOSTROPHE
        allowed = head[1:] & (left != WHITE)
        # no fragment may begin with an apostrophe that stands inside a run of other characters
        allowed &= ~((left == OTHER) & mark[1:])
        # nor may one end inside a contraction of two or three characters
        allowed &= ~(mark[:-1] & (right == LETTER))
        allowed[1:] &= ~(mark[:-2] & (left[1:] == LETTER) & (right[1:] == LETTER))
        return np.flatnonzero(allowed & ~self.inside[data[:-1], data[1:]]) + 1

    def merge(self, piece: bytes) -> list[int]:
        """Merge the lowest-ranked neighbours of a piece, leftmost first, until none is left."""
        if len(piece) > SHORT:
            return self.merge_long(piece)
        single, made, rank, never = self.single, self.made, self.rank.get, len(self.made)
        ids = [single[b] for b in piece]
        ranks = [rank(pair, never) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            ids[i] = made[least]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), never)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), never)
        return ids

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap, in a time that is not quadratic in the piece's length."""
        ids = [self.single[b] for b in piece]
        n, rank, made = len(ids), self.rank, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            least, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made[least], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def fragment(self, raw: bytes) -> tuple[int, ...]:
        """The ids of one fragment."""
        if raw.isalpha() or (raw[:1] == b" " and raw[1:].isalpha()):
            # ASCII letters after at most one space are one piece
            ids = tuple(self.merge(raw))
        else:
            ids = tuple(i for piece in PIECES.findall(raw.decode()) for i in self.merge(piece.encode()))
        if len(raw) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[raw] = ids
        return ids

    def specials(self, raw: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Begin and end of the text of each special token inside a document."""
        spans, at = [], 0
        while self.find_special and (m := self.find_special.search(raw, at)):
            begin, at = m.span()
            edge = int(offsets[np.searchsorted(offsets, begin, "right")])
            if at <= edge:
                spans.append((begin, at))
            else:
                at = edge
        return spans

    def encode_group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole documents that lie one after another, and how many each has."""
        raw, docs = data.tobytes(), len(offsets) - 1
        special = self.specials(raw, offsets)
        cut = np.zeros(len(data) + 1, bool)
        cut[self.cuts(data)] = True
        for a, b in special:
            cut[a:b] = False
            cut[[a, b]] = True
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        bounds, known, fragment = edges.tolist(), self.known, self.fragment
        ids = [known.get(f) or fragment(f) for f in [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]]
        for a, b in special:
            ids[int(np.searchsorted(edges, a))] = (self.special[raw[a:b]],)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(edges, offsets)]
        return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), np.diff(total) if docs else np.zeros(0, np.int64)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; the text of a special token becomes that token."""
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_group(data, np.array([0, len(data)]))[0]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of the ids, special tokens included; broken UTF-8 becomes U+FFFD.

        Ids outside the vocabulary are skipped.
        """
        token, n = self.token, len(self.token)
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        if ids and (min(ids) < 0 or max(ids) >= n):
            ids = [i for i in ids if 0 <= i < n]
        return b"".join([token[i] for i in ids]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec in a worker for each file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _in_groups(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of few bytes, so that no large batch of long texts is in hand at once."""
    at, n, each = 0, batch.num_rows, max(1, batch.num_rows * GROUP // max(GROUP, batch.column(column).nbytes))
    while at < n:
        yield batch.slice(at, each)
        at += each


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the ids (array<int>) of each whole text; null text has no ids.

    ``vocabulary`` is the path of a byte-level BPE file, the same on every
    machine. A column that already has the name of ``out`` is replaced.
    """
    rest = docs.drop(out)
    schema = rest.withColumn(out, F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for a, b, data, offsets in groups(text_array(batch.column(text_col))):
                part, (ids, counts) = batch.slice(a, b - a), c.encode_group(data, offsets)
                yield pa.RecordBatch.from_arrays([*part.columns, lists(ids, counts, pa.int32())], [*part.schema.names, out])

    return rest.mapInArrow(run, schema)


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the text of each id list; null ids give an empty text."""
    rest = docs.drop(out)
    schema = rest.withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for part in _in_groups(batch, ids_col):
                column = part.column(ids_col).fill_null([]) if part.column(ids_col).null_count else part.column(ids_col)
                flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))))
                texts = [c.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])

    return rest.mapInArrow(run, schema)
