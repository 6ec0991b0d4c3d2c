"""A bounded sample of labelled documents for fitting classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import held_out, stored


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, at_most: int, modulus: int, remainder: int, path: str, bytes_at_most: int | None = None) -> DataFrame:
    """At most ``at_most`` documents (doc_id, text) with ``label`` as ``y``, never held-out ones.

    The sample is the labelled identifiers with the smallest hashes, so it does not
    depend on how the table is laid out. If an identifier has several labels the
    largest holds. The broadcast side is that sample's identifiers, bounded by
    ``at_most``. Documents that repeat an identifier count once, by their largest text.
    With ``bytes_at_most``, the sample ends before the document with which its texts
    would have more bytes together; the lengths of ``at_most`` texts are added up in one task.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)
    joined = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y"))
    sample = stored(joined, path)
    if bytes_at_most is None:
        return sample
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    whole = sample.select("doc_id", upto.alias("upto")).where(F.col("upto") <= bytes_at_most).select("doc_id")
    return sample.join(F.broadcast(whole), "doc_id")


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a non-decreasing map from score to probability.

    One half of a positive and of a negative example are added to every pool, so no
    pool claims certainty. Without examples the map is constant at one half.
    """
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([s, s, t, 1.0])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            last = pools.pop()
            pools[-1][1] = last[1]
            pools[-1][2] += last[2]
            pools[-1][3] += last[3]
    x = np.array([v for p in pools for v in (p[0], p[1])])
    p = np.maximum.accumulate(np.array([(v[2] + 0.5) / (v[3] + 1) for v in pools for _ in (0, 1)]))
    return x, p
