"""The classifiers, line dedup and the near-duplicate search against plain Python versions of what they compute."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docweave.llm import language_id, quality, toxicity
from docweave.llm.labelled import isotonic
from docweave.llm.lines import LINES_PER_CHUNK, drop_repeated_chunks
from docweave.llm.near_dedup import near_duplicates
from docweave.llm.textkernel import LOWER, mix

from .test_edges import brute_components

TEXTS = ["you are a Fool and a clown", "fool fool fool", "", "a calm note about rivers, 12 of them", "É clown!! ninth", "word " * 200 + "clown"]


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)


# factorization machine


def plain_buckets(text):
    """The buckets of a text, with hashes of the same kernel for one word at a time."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(LOWER[np.frombuffer(text.encode(), np.uint8)]) if text else b"")
    one = lambda w: toxicity.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
    times = Counter()
    for w in words:
        times[int(one(w)[0]) & ~3] += 1
        for n in toxicity.PREFIXES:
            if len(w) > n:
                times[int(mix(one(w[:n]) + np.uint64(0xABC8 + n))[0]) & ~3] += 1
    keys = set()
    for k, c in times.items():
        keys |= {k, *(k | (i + 1) for i, r in enumerate(toxicity.RATES) if c > 1 and c / len(words) >= r)}
    return {int(mix(np.array([k], np.uint64))[0]) >> (64 - toxicity.BITS) for k in keys}


def test_factorization_machine_sums_over_all_pairs():
    model, rng = toxicity.Machine(), np.random.default_rng(2)
    model.bias, model.w = -0.3, rng.normal(size=model.w.shape).astype(np.float32)
    model.v, model.value = rng.normal(size=model.v.shape).astype(np.float32) / 4, rng.uniform(0.05, 1, model.value.shape).astype(np.float32)
    doc, bucket = toxicity.features(*packed(TEXTS))
    raw = model.raw(bucket, np.bincount(doc, minlength=len(TEXTS)))
    for i, t in enumerate(TEXTS):
        own = sorted(plain_buckets(t))
        assert own == bucket[doc == i].tolist()
        x = {f: float(model.value[f]) for f in own}
        want = model.bias + sum(float(model.w[f]) * x[f] for f in own)
        want += sum(float(model.v[f] @ model.v[g]) * x[f] * x[g] for k, f in enumerate(own) for g in own[k + 1 :])
        assert raw[i] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_factorization_machine_learns_an_interaction_of_neutral_words(spark):
    """Two words are each as frequent in both classes; only together they mean the label."""
    rnd, rows, marks = random.Random(4), [], []
    for i in range(1600):
        has = (rnd.random() < 0.5, rnd.random() < 0.5)
        filler = rnd.choices([f"f{k}" for k in range(30)], k=6)
        rows.append((i, " ".join([*filler, *(w for w, h in zip(("greenish", "folk"), has) if h)])))
        marks.append((i, int(has[0] == has[1])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    scored = toxicity.score_toxicity(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int")).collect()
    out, truth = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2], dict(marks)
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in out) >= 0.9 * len(out)


# kernel ridge and calibration


def test_random_fourier_features_approach_the_gaussian_kernel():
    rng, k = np.random.default_rng(3), len(quality.STATISTICS)
    model = quality.Classifier(np.zeros(k), np.ones(k))
    x = rng.normal(size=(60, k))
    z = model.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * k / 4))
    assert np.abs(z @ z.T - want).max() < 5 / math.sqrt(quality.FEATURES)


def test_quality_solves_the_ridge_equations_over_all_partitions(spark):
    """What the partitions' sums give equals a solution over all rows at once; the scores follow from it."""
    rnd = random.Random(8)
    texts = {i: " ".join(rnd.choices(["the", "of", "river", "###", "CLICK", "stone."], k=rnd.randrange(1, 60))) for i in range(300)}
    marks = {i: int("###" not in t[:60]) for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame(list(marks.items()), "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    folds = {r.doc_id: r.fold for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 11), 4) AS fold").collect()}
    stats = quality.statistics(*packed(texts.values()))
    learn = np.array([zlib.crc32(str(i).encode()) % 4 != 2 for i in texts])
    fold, y = np.array([folds[i] for i in texts]), np.array([marks[i] for i in texts], float)
    z = model.features(stats[learn & (fold != 0)])
    w = np.linalg.solve(z.T @ z / len(z) + quality.RIDGE * np.eye(z.shape[1]), z.T @ y[learn & (fold != 0)] / len(z))
    assert np.allclose(model.weights, w, atol=1e-6)
    x, p = isotonic(model.features(stats[learn & (fold == 0)]) @ w, y[learn & (fold == 0)])
    want = np.interp(model.features(stats) @ w, x, p)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    assert np.allclose([got[i] for i in texts], want, atol=1e-6)


def test_isotonic_is_the_closest_monotone_map():
    """Pools are averages, and no other split of the order is closer; by dynamic programming over levels."""
    rng = np.random.default_rng(6)
    s = rng.normal(size=60)
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * s))).astype(float)
    order = np.argsort(s)
    x, p = isotonic(s, y)
    assert (np.diff(p) >= 0).all() and (np.diff(x) >= 0).all()
    # max-min formula of isotonic regression, with the half example of either class added to each pool
    t = y[order]
    fit = [max(min(t[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    pools = defaultdict(list)
    for v, one in zip(fit, t, strict=True):
        pools[round(v, 9)].append(one)
    want = {k: (sum(v) + 0.5) / (len(v) + 1) for k, v in pools.items()}
    level = np.maximum.accumulate([want[k] for k in sorted(want)])
    assert set(np.round(p, 9)) == set(np.round(level, 9))


# language


def test_follow_the_regularised_leader_equals_its_formulas():
    rng = np.random.default_rng(5)
    model = language_id.Identifier(["a", "b", "c"], np.ones(language_id.BUCKETS))
    rows = [(np.sort(rng.choice(40, 6, replace=False)).astype(np.int32), rng.random(6).astype(np.float32)) for _ in range(50)]
    y = rng.integers(0, 3, 50)
    model.fit(rows, y, seed=9)
    z, n = defaultdict(float), defaultdict(float)

    def weight(at):
        if abs(z[at]) <= language_id.L1:
            return 0.0
        return -(z[at] - math.copysign(language_id.L1, z[at])) / ((language_id.BETA + math.sqrt(n[at])) / language_id.ALPHA + language_id.L2)

    order = np.random.default_rng(9)
    for _ in range(language_id.EPOCHS):
        for i in order.permutation(50):
            x = [*zip(rows[i][0].tolist(), rows[i][1].tolist()), ("bias", 1.0)]
            s = [sum(v * weight((f, k)) for f, v in x) for k in range(3)]
            e = [math.exp(v - max(s)) for v in s]
            for k in range(3):
                for f, v in x:
                    g, w = v * (e[k] / sum(e) - (k == y[i])), weight((f, k))
                    sigma = (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / language_id.ALPHA
                    z[f, k] += g - sigma * w
                    n[f, k] += g * g
    for f in range(40):
        for k in range(3):
            assert model.weights[f, k] == pytest.approx(weight((f, k)), abs=1e-5)
    assert [weight(("bias", k)) for k in range(3)] == pytest.approx(model.bias.tolist(), abs=1e-5)
    assert (model.weights == 0).any()


def test_language_features_count_every_n_gram():
    texts = ["Ab, a b", "éÉ x", "123", "aaaa"]
    points, at = language_id.code_points(*packed(texts))
    counts, letters = language_id.counted(points, at)
    assert letters.tolist() == [True, True, False, True]
    for i, t in enumerate(texts):
        plain = "".join(c if c.isalpha() else " " for c in t.lower())
        want = Counter(plain[k : k + n] for n in language_id.LENGTHS for k in range(len(plain) - n + 1) if plain[k : k + n].strip())
        # hashed buckets keep the total, and a count for each n-gram unless two share a bucket
        assert counts[i].sum() == sum(want.values()) and sorted(counts[i][counts[i] > 0]) == sorted(want.values())


# line dedup


def plain_line_dedup(docs):
    """What is left of each document, with passages as whole byte strings."""

    def passages(lines):
        filled = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        yield from zip(filled, filled[1:])
        yield from ((k, k) for k, x in enumerate(lines) if len(re.findall(r"[^\x20\x09-\x0D]+", x)) > 50)

    seen, out = {}, {}
    for i in sorted(docs):
        lines = docs[i].split("\n") if docs[i] else []
        gone = set()
        for a, b in sorted(passages(lines), key=lambda s: s):
            t = "\n".join(lines[a : b + 1])
            where = seen.setdefault(t, (i, b))
            if where[0] != i or a > where[1]:
                gone |= set(range(a, b + 1))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else docs[i]
    return out


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    """Lines of a small stock in any order: pairs, long lines, blanks, overlaps, repeats inside a document.

    Every chunk of two or more lines that aren't blank consists of pairs; so whatever a
    repeated chunk covers, but for blank lines at its ends, pairs and long lines cover too.
    """
    rnd = random.Random(12)
    stock = [f"line {k}" for k in range(25)] + ["", "  ", "dup", "dup"] + [" ".join(f"l{k}w{j}" for j in range(51)) for k in range(3)]
    docs = {i: "\n".join(rnd.choice(stock) if rnd.random() < 0.5 else f"own {i} {k}" for k in range(rnd.randrange(40))) for i in range(120)}
    got = {r.doc_id: r.text for r in drop_repeated_chunks(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(6)).collect()}
    want = plain_line_dedup(docs)
    solid = lambda t: [x for x in t.split("\n") if x.strip()]
    assert {i: solid(t) for i, t in got.items()} == {i: solid(t) for i, t in want.items()}
    assert LINES_PER_CHUNK > 1 and sum(got[i] != docs[i] for i in docs) > 60


# recall of the near-duplicate search


@pytest.mark.parametrize(("size", "groups"), [(2, 60), (20, 12), (40, 8), (200, 2), (700, 1)])
def test_recall_of_near_duplicates_by_group_size(spark, size, groups):
    """Groups that drift: each text is a copy of an earlier one with a similarity just above the threshold.

    Counted are the brute-force links whose two ends end in one component.
    """
    rnd, texts = random.Random(size), {}
    for g in range(groups):
        made = []
        for _ in range(size):
            own = list(rnd.choice(made[-3:])) if made else [f"g{g}w{rnd.randrange(10**6)}" for _ in range(100)]
            # five changed words apart change ten of 99 pairs: 89 / 109 = 0.816
            for at in range(rnd.randrange(15), 100, 20) if made else ():
                own[at] = f"x{rnd.randrange(10**7)}"
            made.append(own)
            texts[len(texts)] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=2).collect()}
    sets = {i: {tuple(p) for p in zip(w, w[1:])} for i, t in texts.items() for w in [t.split(" ")]}
    links = [(a, b) for g in range(groups) for a in range(g * size, (g + 1) * size) for b in range(a + 1, (g + 1) * size) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = sum(got[a] == got[b] for a, b in links)
    print(f"groups of {size}: {found} of {len(links)} links")
    assert len(links) >= groups * (size - 1) and found >= 0.995 * len(links)
    if size <= 40:
        roots = brute_components(texts, 80)
        assert all(roots[got[i]] == roots[i] for i in texts)
