"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import isotonic, labelled_sample
from .shared import id_and_text, stored, workspace
from .textkernel import LOWER, U, groups, mix, split, text_array, window_hashes, word_hashes

#: Bound of the labelled sample that the classifier is fitted on.
TRAIN_DOCS = 30_000
#: Random features, and the most tasks whose normal equations are summed, which bounds what the driver gets.
FEATURES, TASKS = 256, 8
RIDGE = 1e-3
STATISTICS = ("words", "word_bytes", "distinct", "same_as_last", "repeated_pairs", "upper", "digits", "marks", "marked_words", "loud_words", "stops", "odd_marks", "line_words", "distinct_lines", "long_words")
_ODD = np.zeros(256, bool)
_ODD[list(b"*$&#%|<>{}[]\\^~=+_@")] = True
_MARK = np.array([32 < i < 127 and not chr(i).isalnum() for i in range(256)])


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct values in each document."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, bool)
    return np.bincount(d[new], minlength=n).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ``STATISTICS`` of each document; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    words = split(data, offsets)
    low = split(LOWER[data], offsets)
    h, counts, doc = word_hashes(low), words.counts.astype(float), words.doc_of()
    some = np.maximum(counts, 1)
    upper, digit, mark, odd = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), _MARK[data], _ODD[data]
    up_at, mark_at = np.concatenate(([0], np.cumsum(upper))), np.concatenate(([0], np.cumsum(mark)))
    length = words.ends - words.starts
    marked = mark_at[words.ends] - mark_at[words.starts]
    loud = up_at[words.ends] - up_at[words.starts]
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))) if len(h) else np.zeros(0, bool)
    pair, room = window_hashes(h, 2), words.room(2)[:-1] if len(h) else np.zeros(0, bool)
    pairs = np.bincount(doc[:-1][room], minlength=n) if len(h) > 1 else np.zeros(n)
    pair_kinds = _distinct(pair[room], doc[:-1][room], n) if len(h) > 1 else np.zeros(n)
    by_word = lambda x: np.bincount(doc, weights=x, minlength=n)
    breaks = data == 0x0A
    lines = _per_doc(breaks, offsets) + 1
    # a line's hash is the sum of its words' hashes
    at_break = np.concatenate(([0], np.cumsum(breaks)))
    line_of = at_break[words.starts] + doc
    line, where = np.unique(line_of, return_inverse=True)
    sums = np.zeros(len(line), np.uint64)
    np.add.at(sums, where, mix(h + U(1)))
    line_doc = np.zeros(len(line), np.int64)
    line_doc[where] = doc
    filled = np.maximum(np.bincount(line_doc, minlength=n), 1)
    return np.column_stack(
        [
            np.log1p(counts),
            np.log1p(by_word(length) / some),
            _distinct(h, doc, n) / some,
            by_word(same) / some,
            1 - pair_kinds / np.maximum(pairs, 1),
            _per_doc(upper, offsets) / size,
            _per_doc(digit, offsets) / size,
            _per_doc(mark, offsets) / size,
            by_word(marked >= 2) / some,
            by_word((loud >= 2) & (loud + marked >= 0.6 * length)) / some,
            _per_doc(data == 0x2E, offsets) / some,
            _per_doc(odd, offsets) / size,
            np.log1p(counts / lines),
            _distinct(sums, line_doc, n) / filled,
            by_word(length > 20) / some,
        ]
    )


class Classifier:
    """Standardised statistics, cosine features of a Gaussian kernel, ridge weights, calibration points."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        self.mean, self.scale = mean, scale
        random = np.random.default_rng(seed)
        self.direction = random.normal(size=(len(STATISTICS), FEATURES)) / np.sqrt(len(STATISTICS) / 4)
        self.phase = random.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.x, self.p = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(x @ self.direction + self.phase) * np.sqrt(2 / FEATURES), np.ones(len(x))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.x, self.p)


def fit(texts: DataFrame, labels: DataFrame, label: str = "quality", at_most: int = TRAIN_DOCS, modulus: int = 4, remainder: int = 2) -> Classifier:
    """Fit on at most ``at_most`` labelled documents outside the held-out ones.

    Three quarters give the normal equations: each of at most ``TASKS`` tasks sums
    the products of its rows' features, and the driver adds those few matrices and
    solves. The last quarter gives the calibration. The means and deviations that
    scale the statistics are those of all texts. Nothing else is gathered.
    """
    spark = texts.sparkSession
    space = workspace(spark, "quality")
    sample = labelled_sample(texts, labels, label, at_most, modulus, remainder, f"{space}/sample")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in groups(text_array(batch.column("text"))):
                s = statistics(data, offsets)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), batch.column("y").slice(a, b - a), *(pa.array(s[:, i]) for i in range(s.shape[1]))], names=["doc_id", "y", *STATISTICS])

    def every_statistic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in groups(text_array(batch.column("text"))):
                s = statistics(data, offsets)
                yield pa.record_batch([pa.array(s[:, i]) for i in range(s.shape[1])], names=list(STATISTICS))

    rows = stored(sample.mapInArrow(measure, "doc_id bigint, y int, " + ", ".join(f"{c} double" for c in STATISTICS)), f"{space}/statistics")
    # scaled over every document, labelled or not
    every = texts.mapInArrow(every_statistic, ", ".join(f"{c} double" for c in STATISTICS))
    moments = every.agg(*(F.avg(c) for c in STATISTICS), *(F.stddev_pop(c) for c in STATISTICS)).first()
    values = np.array([0.0 if v is None else v for v in moments])
    k = len(STATISTICS)
    model = Classifier(values[:k], np.where(values[k:] > 1e-9, values[k:], 1.0))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z = model.features(np.column_stack([batch.column(c).to_numpy() for c in STATISTICS]))
            left += z.T @ z
            right += z.T @ batch.column("y").to_numpy()
        yield pa.record_batch([pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["left", "right"])

    parts = rows.where(fold != 0).coalesce(TASKS).mapInArrow(products, "left binary, right binary").collect()
    left = sum((np.frombuffer(r["left"]).reshape(FEATURES + 1, -1) for r in parts), np.zeros((FEATURES + 1, FEATURES + 1)))
    right = sum((np.frombuffer(r["right"]) for r in parts), np.zeros(FEATURES + 1))
    n = left[-1, -1]
    if n:
        model.weights = np.linalg.solve(left / n + RIDGE * np.eye(FEATURES + 1), right / n)
    kept = rows.where(fold == 0).select("y", *STATISTICS).toArrow()
    if kept.num_rows:
        model.x, model.p = isotonic(model.raw(np.column_stack([kept.column(c).to_numpy() for c in STATISTICS])), kept.column("y").to_numpy())
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", append: bool = False, **fitting: object) -> DataFrame:
    """A calibrated quality score (0 to 1) of every whole text.

    The statistics look at the text alone. Null counts as empty. Without usable
    labels every score is 0.5.

    Returns doc_id, score and nothing else; with ``append`` the columns of ``docs``
    and score, which replaces a column of that name.
    """
    texts = id_and_text(docs, id_col, text_col)
    model = fit(texts, labels, **fitting)
    source, column = (docs.drop("score"), text_col) if append else (texts, "text")
    kept = source.columns if append else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in groups(text_array(batch.column(column))):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(model.score(statistics(data, offsets)))], [*kept, "score"])

    return source.mapInArrow(run, source.select(kept).withColumn("score", F.lit(0.5)).schema)
