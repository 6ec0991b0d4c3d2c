"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import runs
from .decontaminate import alnum_words
from .labelled import isotonic, labelled_sample
from .shared import id_and_text, workspace
from .textkernel import U, Words, groups, mix, span_hashes, text_array

#: Bounds of the labelled sample that the model is fitted on: documents, and bytes of their whole texts.
TRAIN_DOCS, TRAIN_BYTES = 30_000, 256 << 20
#: Terms are hashed into two to the power of so many buckets; each is a feature.
BITS = 18
FACTORS, EPOCHS, BLOCKS, RATE, L2 = 4, 8, 32, 0.05, 1e-5
#: A bucket's value in a text is its chi-square with the label over the first, at most 1; at least the second, and
#: more for a bucket that many documents hold: its share of the documents times the third, so that it can interact.
FULL_CHI, FLOOR, OFTEN = 24.0, 0.05, 5.0
#: Bytes of the beginnings of longer words that are terms too.
PREFIXES = (4, 5)
#: A term that occurs twice or more and makes up such a share of the words is a further feature for each share.
RATES = (1 / 128, 1 / 64, 1 / 32)
_LEVEL = U(3)


def terms(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every hashed term and its document: words, and the beginnings of longer words."""
    doc = words.doc_of()
    keys, docs = [h], [doc]
    for n in PREFIXES:
        long = np.flatnonzero(words.ends - words.starts > n)
        keys.append(mix(span_hashes(words.data, words.starts[long], words.starts[long] + n) + U(0xABC8 + n)))
        docs.append(doc[long])
    return np.concatenate(keys) & ~_LEVEL, np.concatenate(docs)


def leveled(keys: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each term once a document, and once more for each of ``RATES`` that it reaches, in order of documents.

    The last two bits of a key tell the level, so that a level's term is known by
    the others. One word of a short text is a high rate by chance, hence twice.
    """
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])))) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keys)))
    keys, doc = keys[first], doc[first]
    rate = np.where(times > 1, times / np.maximum(sizes[doc], 1), 0)
    reached = [np.flatnonzero(rate >= r) for r in RATES]
    out = np.concatenate([keys, *(keys[at] | U(i + 1) for i, at in enumerate(reached))])
    docs = np.concatenate([doc, *(doc[at] for at in reached)])
    order = np.lexsort((out, docs))
    return out[order], docs[order]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every term of the documents, in order and each once."""
    words, h = alnum_words(data, offsets)
    keys, doc = leveled(*terms(words, h), words.counts)
    both = np.unique(doc.astype(np.int64) << BITS | (mix(keys) >> U(64 - BITS)).astype(np.int64))
    return both >> BITS, (both & ((1 << BITS) - 1)).astype(np.int32)


def entries(bucket: np.ndarray, first: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The buckets of some documents, one document after another."""
    size = counts[rows]
    at = np.repeat((first[rows] - (np.cumsum(size) - size)).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return bucket[at]


class Machine:
    """score = bias + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j, over the buckets of a text.

    Every bucket takes part, so that terms which are neutral alone can interact;
    a rare one that does not go with the label by itself has a small value x.
    """

    def __init__(self, seed: int = 3):
        random = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(1 << BITS, np.float32)
        self.v = random.normal(scale=0.02, size=(1 << BITS, FACTORS)).astype(np.float32)
        self.value = np.full(1 << BITS, FLOOR, np.float32)
        self.x, self.p = np.array([0.0]), np.array([0.5])

    def _forward(self, bucket: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw scores of documents with so many buckets each, the sums of their factors, and each bucket's part of them."""
        n, some = len(counts), np.flatnonzero(counts)
        first = (np.cumsum(counts) - counts)[some]
        own = self.v[bucket] * self.value[bucket][:, None]
        sums, squares, linear = np.zeros((n, FACTORS), np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32)
        if len(some):
            sums[some] = np.add.reduceat(own, first, axis=0)
            squares[some] = np.add.reduceat((own * own).sum(axis=1), first)
            linear[some] = np.add.reduceat(self.w[bucket] * self.value[bucket], first)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums, own

    def raw(self, bucket: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self._forward(bucket, counts)[0].astype(np.float64)

    def fit(self, bucket: np.ndarray, counts: np.ndarray, y: np.ndarray, rows: np.ndarray, seed: int = 5) -> None:
        """Minimise the logistic loss over ``rows`` of the documents with AdaGrad, a block of them at a time."""
        first, random = np.cumsum(counts) - counts, np.random.default_rng(seed)
        share = min(max(float(y[rows].mean()), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        blocks = [np.sort(b) for b in np.array_split(random.permutation(rows), min(BLOCKS, len(rows)))]
        held, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for b in blocks:
            held += np.bincount(entries(bucket, first, counts, b), minlength=1 << BITS)
            bad += np.bincount(entries(bucket, first, counts, b[y[b] > 0]), minlength=1 << BITS)
        expected = held * share
        # with a continuity correction, as most buckets are held by few documents
        off = np.maximum(np.abs(bad - expected) - 0.5, 0)
        least = np.clip(OFTEN * held / len(rows), FLOOR, 1)
        self.value = np.clip(off**2 / np.maximum(expected * (1 - share), 1e-9) / FULL_CHI, least, 1).astype(np.float32)
        gw, gv = np.full(self.w.shape, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32)
        for _ in range(EPOCHS):
            for i in random.permutation(len(blocks)):
                rows, size = blocks[i], counts[blocks[i]]
                f = entries(bucket, first, counts, rows)
                raw, sums, own = self._forward(f, size)
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]).astype(np.float32)
                self.bias -= RATE * float(err.mean())
                if not len(f):
                    continue
                # gradients are summed over the entries of each bucket
                of = np.repeat(np.arange(len(rows), dtype=np.int32), size)
                step = err[of] * self.value[f]
                order = np.argsort(f, kind="stable")
                begin = np.flatnonzero(np.diff(f[order], prepend=-1))
                used = f[order][begin]
                dw = np.add.reduceat(step[order], begin) / len(rows) + L2 * self.w[used]
                dv = np.add.reduceat(((sums[of] - own) * step[:, None])[order], begin, axis=0) / len(rows) + L2 * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE / 2 * dv / np.sqrt(gv[used])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, bucket = features(data, offsets)
        return np.interp(self.raw(bucket, np.bincount(doc, minlength=len(offsets) - 1)), self.x, self.p)


def fit(texts: DataFrame, labels: DataFrame, label: str = "toxic", at_most: int = TRAIN_DOCS, bytes_at_most: int = TRAIN_BYTES, modulus: int = 4, remainder: int = 2) -> Machine:
    """Fit on at most ``at_most`` labelled documents outside the held-out ones, of ``bytes_at_most`` bytes together.

    Spark turns the sample into sorted, packed runs of (document, bucket), which
    come to the driver: a few bytes for each distinct term of a document, and so
    bounded by the bytes of the sample. Four fifths fit the machine, the last fifth
    its calibration. The model's size is fixed by ``BITS``, whatever the vocabulary.
    """
    sample = labelled_sample(texts, labels, label, at_most, modulus, remainder, f"{workspace(texts.sparkSession, 'toxicity')}/sample", bytes_at_most)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in groups(text_array(batch.column("text"))):
                doc, bucket = features(data, offsets)
                run = runs.pack((doc << BITS | bucket).astype(np.uint64), [])
                ids, y = (batch.column(c).slice(a, b - a).to_pylist() for c in ("doc_id", "y"))
                yield pa.record_batch([pa.array([ids], pa.list_(pa.int64())), pa.array([y], pa.list_(pa.int32())), pa.array([run], pa.binary())], names=["ids", "y", "run"])

    model, parts = Machine(), sample.mapInArrow(encode, "ids array<bigint>, y array<int>, run binary").collect()
    if not parts:
        return model
    ids, y = (np.array([x for r in parts for x in r[c]]) for c in ("ids", "y"))
    counts, buckets = [], []
    while parts:
        r = parts.pop(0)
        keys = runs.unpack(r["run"])[0].astype(np.int64)
        counts.append(np.bincount(keys >> BITS, minlength=len(r["ids"])))
        buckets.append((keys & ((1 << BITS) - 1)).astype(np.int32))
    counts, buckets, y, order = np.concatenate(counts), np.concatenate(buckets), (y > 0).astype(float), np.argsort(ids)
    last = np.arange(len(order)) % 5 == 0
    if not last.all():
        model.fit(buckets, counts, y, order[~last])
    check = order[last]
    model.x, model.p = isotonic(model.raw(entries(buckets, np.cumsum(counts) - counts, counts, check), counts[check]), y[check])
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting: object) -> DataFrame:
    """A calibrated toxicity score (0 to 1) of every whole text.

    A-Z is lower-cased; words are runs of ASCII letters and digits or bytes of other
    alphabets. Words and their beginnings are terms; a term's presence and the shares of
    the text that it reaches are hashed into buckets, however long the text; no term is
    left out. Null counts as empty. Without usable labels every score is 0.5. Rows that
    repeat an identifier are scored one by one. Other columns are ignored.

    Returns doc_id, score.
    """
    texts = id_and_text(docs, id_col, text_col)
    model = fit(texts, labels, **fitting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in groups(text_array(batch.column("text"))):
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(model.score(data, offsets))], names=["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id bigint, score double")
