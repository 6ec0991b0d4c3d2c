"""The pipeline stage by stage, each judged on its own input, against brute force."""

import os
import re

import corpus_pipeline as cp
import pytest
from docweave.llm.quality import score_quality
from docweave.llm.shared import stored, workspace

from .test_edges import brute_components

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returned, by its place; 0 is the table."""
    out, space = [spark.read.parquet(f"{DIR}/documents.parquet")], workspace(spark, "pipeline-test")
    for i, (_, stage) in enumerate(cp.STAGES):
        out.append(stored(stage(spark, out[-1], DIR), f"{space}/{i}"))
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_columns_and_stages(kept):
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    assert all(df.columns == kept[0].columns for df in kept[:5])
    assert [df.count() for df in kept] == sorted((df.count() for df in kept), reverse=True)


def test_quality(spark, kept):
    scores = {r.doc_id: r.score for r in score_quality(kept[0], spark.read.parquet(f"{DIR}/labels.parquet")).collect()}
    assert set(texts(kept[1])) == {i for i, s in scores.items() if s >= cp.LEAST_QUALITY}


def test_line_dedup(kept):
    before, after = texts(kept[1]), texts(kept[2])
    for i, t in after.items():
        rest = iter(before[i].split("\n"))
        assert all(line in rest for line in t.split("\n")) if t != before[i] else True
    assert all(r.n_chars == len(r.text) for r in kept[2].collect() if r.text != before[r.doc_id])


def test_near_dedup(kept):
    before = texts(kept[2])
    roots = brute_components(before, 80, shingle=5)
    assert set(texts(kept[3])) == {i for i in before if roots[i] == i}


def test_decontaminate(spark, kept):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    where = {}
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = words(r.text)
        for i in range(len(w) - 7):
            where.setdefault(tuple(w[i : i + 8]), set()).add(r.item_id)
    clean = set()
    for i, t in texts(kept[3]).items():
        w = words(t)
        items, hit = set(), [False] * len(w)
        for k in range(len(w) - 7):
            if found := where.get(tuple(w[k : k + 8])):
                items |= found
                hit[k : k + 8] = [True] * 8
        longest = max(map(len, "".join("x" if h else " " for h in hit).split()), default=0)
        if len(items) < cp.MOST_ITEMS and longest < cp.LONGEST_RUN:
            clean.add(i)
    assert set(texts(kept[4])) == clean


def test_bpe(kept):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, before = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), texts(kept[4])
    got = {r.doc_id: (r.n_tokens, r.ids) for r in kept[5].collect()}
    assert got == {i: (len(ids), ids) for i, x in before.items() for ids in [t.encode(x, add_special_tokens=False).ids]}
