"""Registered queries of the operators against DuckDB, and against brute force where SQL has no way."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from docweave.llm.queries import oracle_sql, queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, oracle, name):
    out = queries()[name](spark, DIR)
    columns = sorted(out.columns)
    want = oracle.sql(oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = lambda found, at: sorted(tuple(str(r[i]) for i in at) for r in found)
    assert rows(out.select(columns).collect(), range(len(columns))) == rows(want.fetchall(), [want.columns.index(c) for c in columns])


def test_bpe_equals_the_tokenizers_library(spark, oracle):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    want = {}
    for i, text in oracle.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        ids = t.encode(text, add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    out = queries()["op3_bpe"](spark, DIR).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out} == want


def kneser_ney(train, texts):
    """(n_tokens, n_known, base, score) of each text by dictionaries of strings."""
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    uni, raw, tri = Counter(), Counter(), Counter()
    for t in train:
        words = split(t)
        padded = ["<s>", *words]
        uni.update(words)
        raw.update(zip(padded, words))
        tri.update(zip(padded, words, words[1:]))
    bi = Counter({k: c for k, c in raw.items() if k[0] == "<s>"})
    bi.update((b, c) for _, b, c in tri)
    follow, total, v = Counter(b for _, b in raw), sum(uni.values()), len(uni)

    def discounts(counts):
        n = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
        if min(n[:3]) <= 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3))]

    def order(counts):
        d, sums, kinds = discounts(counts.values()), Counter(), defaultdict(Counter)
        for k, c in counts.items():
            sums[k[:-1]] += c
            kinds[k[:-1]][min(c, 3)] += 1

        def p(gram, lower):
            if not sums[gram[:-1]]:
                return lower
            return (max(counts[gram] - d[min(counts[gram], 3)], 0) + sum(d[k] * n for k, n in kinds[gram[:-1]].items()) * lower) / sums[gram[:-1]]

        return p

    d1, p2, p3 = discounts(follow.values()), order(bi), order(tri)
    rest = sum(d1[min(c, 3)] for c in follow.values()) / len(raw)
    for t in texts:
        words, base, score = split(t), 0.0, 0.0
        padded = [None, "<s>", *words]
        for a, b, c in zip(padded, padded[1:], words):
            base += math.log10((uni[c] + 1) / (total + v + 1))
            p = p2((b, c), max(follow[c] - d1[min(follow[c], 3)], 0) / len(raw) + rest / (v + 1))
            score += math.log10(p if a is None else p3((a, b, c), p))
        yield len(words), sum(uni[w] > 0 for w in words), base, score


def test_kneser_ney_equals_brute_force(spark, oracle):
    docs = oracle.sql("SELECT doc_id, text FROM documents").fetchall()
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    want = dict(zip((i for i, _ in docs), kneser_ney([t for i, t in docs if not out[i]], [t for _, t in docs])))
    found = queries()["op6_kneser_ney"](spark, DIR).collect()
    assert len(found) == len(docs)
    for r in found:
        n, known, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known) == (out[r.doc_id], n, known)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-6)
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out)


@pytest.mark.parametrize(("name", "label", "modulus", "remainder"), [("op1_toxicity", "toxic", 4, 2), ("op9_quality", "quality", 4, 2), ("op5_language", "lang", 5, 0)])
def test_held_out_accuracy(spark, oracle, name, label, modulus, remainder):
    rows = queries()[name](spark, DIR).collect()
    truth = dict(oracle.sql(f"SELECT doc_id, {label} FROM {'documents' if label == 'lang' else 'labels'} WHERE {label} IS NOT NULL").fetchall())
    assert len(rows) == oracle.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) and 0 <= r.score <= 1 for r in rows)
    guess = (lambda r: r.lang_pred) if label == "lang" else (lambda r: r.predicted)
    judged = [(guess(r), truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth and guess(r) != "und"]
    assert sum(a == b for a, b in judged) >= 0.85 * len(judged)
