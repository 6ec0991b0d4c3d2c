"""Language identification: sparse multinomial regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, id_and_text, stored, workspace
from .textkernel import U, groups, mix, text_array

#: Bound of the labelled sample that the weights are fitted on.
TRAIN_DOCS = 6_000
#: Buckets of hashed n-grams; lengths of n-grams.
BUCKETS, LENGTHS = 1 << 15, (1, 2, 3)
#: Follow-the-regularised-leader: learning rate, smoothing, elastic net.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
EPOCHS = 4
DOCS_AT_ONCE = 32
_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points (what isn't a letter is a blank), and each document's beginning."""
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    if heads[-1] != len(points):
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).copy()
        at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    else:
        at = heads[offsets]
    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    points[upper] += 32
    points[~is_letter()[points]] = 32
    return points, at


def counted(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts (documents x BUCKETS), and whether a document has a letter."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    p = points.astype(np.uint64)
    out = np.zeros(n * BUCKETS, np.float32)
    gram, blank = np.zeros(len(p), np.uint64), points == 32
    empty = np.ones(len(p), bool)
    for k in range(1, max(LENGTHS) + 1):
        m = len(p) - k + 1
        if m <= 0:
            break
        gram = gram[:m] * U(0x110000) + p[k - 1 :]
        empty = empty[:m] & blank[k - 1 :]
        if k in LENGTHS:
            ok = ~empty & (doc[:m] == doc[k - 1 :])
            bucket = (mix(gram[ok] + U(k << 60)) >> U(49)).astype(np.int64)
            out += np.bincount(doc[:m][ok] * BUCKETS + bucket, minlength=n * BUCKETS).astype(np.float32)
    letters = np.bincount(doc, weights=~blank, minlength=n) > 0
    return out.reshape(n, BUCKETS), letters


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    points, at = code_points(data, offsets)
    for i in range(0, len(at) - 1, DOCS_AT_ONCE):
        j = min(i + DOCS_AT_ONCE, len(at) - 1)
        yield i, j, *counted(points[at[i] : at[j]], at[i : j + 1] - at[i])


class Identifier:
    """Weights of each language, inverse document frequencies, a temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf.astype(np.float32)
        self.weights, self.bias = np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
        self.temperature = 1.0

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.maximum(norm, 1e-9)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def predict(self, counts: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(counts), np.zeros(len(counts))
        z = self.logits(self.weigh(counts)).astype(float) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, p.max(axis=1), 0.0)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 1) -> None:
        """Follow the regularised leader, one document a step."""
        k = len(self.languages)
        z, n, w = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
        random = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in random.permutation(len(rows)):
                at, x = rows[i]
                at, x = np.append(at, BUCKETS), np.append(x, 1.0)
                zi, ni = z[at], n[at]
                wi = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
                wi[np.abs(zi) <= L1] = 0
                s = x @ wi
                p = np.exp(s - s.max())
                p /= p.sum()
                p[y[i]] -= 1
                g = x[:, None] * p
                sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
                z[at] = zi + g - sigma * wi
                n[at] = ni + g * g
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0
        self.weights, self.bias = w[:-1].astype(np.float32), w[-1].astype(np.float32)

    def calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss."""
        best = np.inf
        for t in np.geomspace(0.05, 20, 61):
            z = logits / t
            loss = float((np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1) - z[np.arange(len(y)), y]).mean())
            if loss < best:
                best, self.temperature = loss, float(t)


def fit(docs: DataFrame, at_most: int = TRAIN_DOCS, modulus: int = 5, remainder: int = 0) -> Identifier:
    """Learn from documents (doc_id, text, lang) with a language, outside the held-out ones.

    Document frequencies of n-grams and the set of languages come from all of them.
    The weights are fitted on at most ``at_most``, the identifiers with the smallest
    hashes; a fifth of these sets the temperature.
    """
    spark = docs.sparkSession
    space = workspace(spark, "language")
    learn = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in groups(text_array(batch.column("text"))):
                for i, j, counts, _ in blocks(data, offsets):
                    df += (counts > 0).sum(axis=0)
                    n += j - i
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(seen, BUCKETS).astype(np.int32)), pa.array(np.append(df[seen], n))], names=["bucket", "df"])

    # at most one row a bucket and task; the sums are no more than BUCKETS rows
    sums = learn.select("text").mapInArrow(frequency, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(BUCKETS + 1)
    df[sums.column("bucket").to_numpy()] = sums.column("df").to_numpy()
    chosen = learn.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(at_most)
    sample = stored(learn.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id"), f"{space}/sample")
    languages = sorted(r[0] for r in learn.select("lang").distinct().collect())
    model = Identifier(languages, np.log((1 + df[-1]) / (1 + df[:-1])) + 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in groups(text_array(batch.column("text"))):
                for i, j, counts, _ in blocks(data, offsets):
                    x = model.weigh(counts)
                    at = [np.flatnonzero(r) for r in x]
                    yield pa.record_batch([batch.column("doc_id").slice(a + i, j - i), batch.column("lang").slice(a + i, j - i), pa.array([k.astype(np.int32).tobytes() for k in at], pa.binary()), pa.array([r[k].astype(np.float32).tobytes() for r, k in zip(x, at, strict=True)], pa.binary())], names=["doc_id", "lang", "at", "x"])

    rows = sample.mapInArrow(encode, "doc_id bigint, lang string, at binary, x binary").orderBy("doc_id", "lang").toArrow()
    if rows.num_rows:
        number = {name: i for i, name in enumerate(languages)}
        y = np.array([number[x] for x in rows.column("lang").to_pylist()])
        each = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32)) for a, x in zip(rows.column("at").to_pylist(), rows.column("x").to_pylist(), strict=True)]
        fold = np.arange(len(y)) % 5 == 0
        train = np.flatnonzero(~fold) if (~fold).any() else np.arange(len(y))
        model.fit([each[i] for i in train], y[train])
        check = np.flatnonzero(fold)
        model.calibrate(np.array([x @ model.weights[a] + model.bias for a, x in (each[i] for i in check)]), y[check])
    return model


def identify_language(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting: object) -> DataFrame:
    """The likeliest language of every whole text.

    ``train`` has doc_id, text and lang. Letters are lower-cased where they are
    ASCII or Latin-1; everything but letters is a blank. A text that is null or has
    no letter is ``und`` with score 0; so is every text if there is nothing to learn
    from. Ties go to the language that sorts first. Other columns are ignored.

    Returns doc_id, lang_pred, score (the calibrated probability).
    """
    model = fit(train, **fitting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in groups(text_array(batch.column("text"))):
                for i, j, counts, letters in blocks(data, offsets):
                    names, score = model.predict(counts, letters)
                    yield pa.record_batch([batch.column("doc_id").slice(a + i, j - i), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
