"""Language-model scoring with an interpolated modified Kneser-Ney trigram model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .packed import Dense, Packed, Pairing
from .shared import id_and_text, shards_for, workspace
from .textkernel import LOWER, U, groups, mix, split, text_array, word_hashes

#: Number of the beginning of a text; words have those from 1 on, and the next one is for words that weren't learnt from.
FIRST = 0
#: Words share numbers beyond so many, so that two fit a key.
MOST_WORDS = (1 << 32) - 2
END = mix(np.array([0x454E44], np.uint64))[0]


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's words and its end, and tokens a document."""
    words = split(LOWER[data], offsets)
    h, counts = word_hashes(words), words.counts + 1
    ends = np.cumsum(counts) - 1
    tokens = np.empty(len(h) + len(counts), np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[ends] = True
    tokens[is_end], tokens[~is_end] = END, h
    return tokens, counts


def word_keys(number: np.ndarray) -> np.ndarray:
    return mix(number + U(1))


def shifted(values: np.ndarray, counts: np.ndarray, first: int) -> np.ndarray:
    """The value before each token of a document, and ``first`` at its beginning."""
    out = np.concatenate((values[:1], values[:-1]))
    out[np.cumsum(counts) - counts] = first
    return out


class Numbers:
    """Numbers of words: places in the sorted table of those learnt from."""

    def __init__(self, unigrams: runs.Store, vocabulary: int):
        self.unigrams, self.strange = unigrams, min(vocabulary, MOST_WORDS) + 1
        self.bits = max(12, self.strange.bit_length())
        self.pairs = Pairing(self.bits, self.bits)

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and number of each token."""
        flat, where = np.unique(tokens, return_inverse=True)
        found, (count, place) = self.unigrams.lookup(flat, [0, -1])
        return count[where], np.where(found, place % MOST_WORDS + 1, self.strange).astype(np.uint64)[where]


def discounts(n: list[float]) -> np.ndarray:
    """D0 to D3 of modified Kneser-Ney from the numbers of entries counted once to four times.

    Where a count of counts is zero, as in a tiny corpus, 0.5, 1 and 1.5 stand in.
    """
    n1, n2, n3, n4 = n[:4]
    if min(n1, n2, n3) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.array([0.0, *(min(max(d[i], 0.05), i - 0.05) for i in (1, 2, 3))])


def _count_of_counts(counts: np.ndarray) -> list[float]:
    return [float((counts == i).sum()) for i in (1, 2, 3, 4)]


def _kinds(counts: np.ndarray, n: int) -> list[np.ndarray]:
    """A column for each of the counts 1 to ``n`` and one for larger ones."""
    return [(counts == i).astype(np.int64) for i in range(1, n + 1)] + [(counts > n).astype(np.int64)]


class Model:
    """The model's tables and totals.

    ``words`` has for each word the sum of the counts of bigrams that it begins, how many of
    these are counted once to four times and more, and the number of bigrams it ends.
    ``stats`` has for each bigram the number of different words before it, and how many of
    the trigrams it begins are counted once, twice and more.
    """

    def __init__(self, numbers: Numbers, words: runs.Store, bigrams: Packed, stats: Dense, trigrams: Packed, triples: Pairing, totals: tuple[int, int], n_words: list[float], n_tri: list[float]):
        self.numbers, self.words, self.bigrams, self.stats, self.trigrams, self.triples = numbers, words, bigrams, stats, trigrams, triples
        (self.tokens, self.vocabulary), self.types = totals, bigrams.size
        self.d_tri, self.d_bi, self.d_cont = discounts(n_tri), discounts(n_words[:4]), discounts(n_words[4:8])
        n1, n2, _, _, words_followed = n_words[4:]
        self.gamma = float(self.d_cont[1:] @ [n1, n2, words_followed - n1 - n2]) / self.types if self.types else 1.0

    @staticmethod
    def _interpolated(count: np.ndarray, total: np.ndarray, kinds: list[np.ndarray], d: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """The discounted share of ``count``, and the rest of the context's mass by ``lower``; only the latter without a context."""
        safe = np.maximum(total, 1)
        rest = np.where(total > 0, (d[1] * kinds[0] + d[2] * kinds[1] + d[3] * kinds[2]) / safe, 1.0)
        return np.maximum(count - d[np.minimum(count, 3)], 0) / safe + rest * lower

    def score(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its count, log10 of the add-one unigram, log10 of the trigram probability."""
        c, number = self.numbers.of(tokens)
        base = np.log10((c + 1) / (self.tokens + self.vocabulary + 1))
        before = shifted(number, counts, FIRST)
        flat = np.unique(np.append(number, U(FIRST)))
        keys = word_keys(flat)
        order = np.argsort(keys)
        word = np.empty((7, len(flat)), np.int64)
        word[:, order] = self.words.lookup(keys[order])[1]
        here, there = np.searchsorted(flat, number), np.searchsorted(flat, before)
        low = np.full(len(tokens), self.gamma / (self.vocabulary + 1))
        if self.types:
            low += np.maximum(word[6] - self.d_cont[np.minimum(word[6], 3)], 0)[here] / self.types

        flat, where = np.unique(self.numbers.pairs.key(before, number), return_inverse=True)
        found, place, (raw,) = self.bigrams.lookup(flat)
        stats = np.zeros((4, len(flat)), np.int64)
        known = np.flatnonzero(found)
        stats[:, known] = self.stats.at(place[known])
        place, raw, (left, *kinds) = np.where(found, place, -1)[where], raw[where], stats[:, where]
        pair = np.where(before == FIRST, raw, left)
        total, one, two, *more = word[:, there][:6]
        p = self._interpolated(pair, total, [one, two, sum(more)], self.d_bi, low)

        head = shifted(place, counts, -1)
        at = np.flatnonzero(head >= 0)
        triple = np.zeros(len(tokens), np.int64)
        flat, where = np.unique(self.triples.key(head[at].astype(np.uint64), number[at]), return_inverse=True)
        triple[at] = self.trigrams.lookup(flat)[2][0][where]
        # each bigram but one that ends a text begins as many trigrams as it has occurrences
        total = np.where(head >= 0, shifted(raw, counts, 0), 0)
        p = self._interpolated(triple, total, [shifted(k, counts, 0) for k in kinds], self.d_tri, p)
        return c, base, np.log10(np.maximum(p, 1e-300))


def fit(texts: DataFrame) -> Model:
    """Count the texts (columns text) and build the model's tables in the shared folder.

    Every token of every text is counted. Map tasks reduce what they read to packed
    sorted runs; reducers merge each shard into sorted hash arrays. Words have 64-bit
    hashes; a bigram's key is exact for the numbers of its two words, which are their
    places among these, and a trigram's for the place of its first two words among the
    bigrams and the number of its third. So different n-grams never share a key, and
    contexts and continuations are read out of the merged keys. Only counts of counts
    come to the driver.
    """
    spark = texts.sparkSession
    space, shards = workspace(spark, "kneser-ney"), shards_for(texts)

    def counted(keys):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = runs.RunMaker(shards, ["sum"])
            for batch in batches:
                for _, _, data, offsets in groups(text_array(batch.column("text"))):
                    found = keys(*token_stream(data, offsets))
                    yield from out.add(found, np.ones(len(found), np.int64))
            yield from out.flush()

        return texts.select("text").mapInArrow(run, runs.RUN_SCHEMA)

    def each(table: Packed, how: list[str], entries):
        """Runs of what ``entries(shard)`` gives for each shard of a table."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = runs.RunMaker(shards, how)
            for batch in batches:
                for s in batch.column("shard").to_pylist():
                    for keys, *columns in entries(s):
                        yield from out.add(keys, *columns)
            yield from out.flush()

        rows = spark.createDataFrame([(s,) for s in table.full], "shard int").repartition(max(1, len(table.full)), "shard")
        return rows.mapInArrow(run, runs.RUN_SCHEMA)

    unigrams, (n_tokens, vocabulary) = runs.build(counted(lambda tokens, _: tokens), f"{space}/1", shards, ["sum"], summary=lambda k, c: (c.sum(), len(k)), n_sums=2)
    numbers = Numbers(unigrams, int(vocabulary))
    pairs = numbers.pairs

    def pair_keys(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        number = numbers.of(tokens)[1]
        return pairs.key(shifted(number, counts, FIRST), number)

    bigrams, _ = Packed.build(counted(pair_keys), f"{space}/2", shards, ["sum"], pairs.bits)
    triples = Pairing(max(16, bigrams.size.bit_length()), numbers.bits)

    def triple_keys(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        number = numbers.of(tokens)[1]
        flat, where = np.unique(pairs.key(shifted(number, counts, FIRST), number), return_inverse=True)
        head = shifted(bigrams.lookup(flat, [])[1][where], counts, -1)
        at = head >= 0
        return triples.key(head[at].astype(np.uint64), number[at])

    trigrams, n_tri = Packed.build(counted(triple_keys), f"{space}/3", shards, ["sum"], triples.bits, summary=lambda k, c: _count_of_counts(c), n_sums=4)
    shift = U(64 - triples.left)

    def bigram_stats(s: int):
        head, last = triples.pair(trigrams.keys(s))
        c, none = trigrams.values(s, 0, slice(None)), np.zeros(len(head), np.int64)
        yield head << shift, none, *_kinds(c, 2)
        order = np.argsort(head)
        middle = pairs.pair(bigrams.keys_at(head[order].astype(np.int64)))[1]
        tail = np.sort(pairs.key(middle, last[order]))
        yield bigrams.lookup(tail, [])[1].astype(np.uint64) << shift, none + 1, none, none, none

    stats = Dense.build(each(trigrams, ["sum"] * 4, bigram_stats), f"{space}/stats", shards, ["sum"] * 4, triples.left)
    first_places = dict(zip(bigrams.full, bigrams.starts.tolist(), strict=True))

    def word_stats(s: int):
        first, last = pairs.pair(bigrams.keys(s))
        raw = bigrams.values(s, 0, slice(None))
        left = stats.at(np.arange(len(raw)) + first_places[s])[0]
        c, none = np.where(first == FIRST, raw, left), np.zeros(len(raw), np.int64)
        yield word_keys(first), c, *_kinds(c, 4), none
        yield word_keys(last), *[none] * 6, none + 1

    words, n_words = runs.build(
        each(bigrams, ["sum"] * 7, word_stats), f"{space}/words", shards, ["sum"] * 7, n_sums=9,
        summary=lambda k, *c: (*(x.sum() for x in c[1:5]), *_count_of_counts(c[6]), (c[6] > 0).sum()),
    )
    return Model(numbers, words, bigrams, stats, trigrams, triples, (int(n_tokens), int(vocabulary)), n_words, n_tri)


def score_texts(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log probabilities of whole texts under a model of ``train`` (column ``text_col``).

    A-Z is lower-cased; tokens are the words ``[^\\x20\\x09-\\x0D]+`` and one end a
    text. Null text counts as empty: its only token is the end. With nothing to
    learn from, every token has the probability 1 / (V + 1) = 1. Workers map the
    model's sorted arrays from the shared folder.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigrams),
    score (the trigram model), both summed log10.
    """
    model = fit(train.select(F.col(text_col).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in groups(text_array(batch.column("text"))):
                tokens, counts = token_stream(data, offsets)
                c, base, score = model.score(tokens, counts)
                first = np.cumsum(counts) - counts
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, b - a), pa.array(counts, pa.int64()), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), pa.array(np.full(b - a, model.tokens, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(score, first))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
