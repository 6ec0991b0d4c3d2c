"""What each operator gives for nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docweave.llm.bpe import decode, encode
from docweave.llm.decontaminate import benchmark_hits
from docweave.llm.exact_dedup import exact_groups
from docweave.llm.kneser_ney import score_texts
from docweave.llm.language_id import identify_language
from docweave.llm.lines import drop_repeated_chunks
from docweave.llm.near_dedup import near_duplicates
from docweave.llm.quality import score_quality
from docweave.llm.substrings import repeated_passages
from docweave.llm.toxicity import score_toxicity

from .test_edges import ROWS, SCHEMA, WORDS
from .test_oracles import kneser_ney

#: Longer than what a worker has in hand at once, so it forms a group of its own.
HUGE = "\n".join(" ".join(random.Random(n).choices(WORDS, k=20)) for n in range(14_000))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if i else None, 3, "k", 4, "p", 5) for i, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, k % 2, k % 2) for i in (1, 2, 3, 4, 5, 6, 8, 9) for k in (i, i)] + [(None, 1, 1), (4, None, None), (12345, 0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def pairs(out, *columns):
    """Rows as (doc_id, values...), in order; several for a repeated identifier."""
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0))


@pytest.mark.parametrize("make", [lambda d, marks: score_toxicity(d, marks), lambda d, marks: score_quality(d, marks)])
def test_scores(odd, labels, make):
    out = make(odd, labels)
    assert out.columns == ["doc_id", "score"]
    got = pairs(out, "score")
    assert [i for i, _ in got] == sorted(i for i, _ in ROWS if i) + [None] and all(0 <= s <= 1 for _, s in got)
    score = dict(got)
    # null is as good as empty, a repeated row or an equal text scores the same
    assert score[1] == score[2] and score[6] == score[8] and len({s for i, s in got if i in (4, 5)}) == 1


def test_scores_without_labels(spark, odd, labels):
    for marks in (labels.where("false"), labels.where("toxic IS NULL")):
        assert {s for _, s in pairs(score_toxicity(odd, marks), "score")} == {0.5}
        assert {s for _, s in pairs(score_quality(odd, marks), "score")} == {0.5}


def test_quality_passes_other_columns_on(odd, labels):
    out = score_quality(odd, labels, append=True)
    assert out.columns == [c for c in odd.columns if c != "score"] + ["score"]
    assert sorted(r.kept for r in out.collect()) == ["k"] * len(ROWS)


def test_language(spark, odd):
    train = spark.createDataFrame([(i, t, g) for i in range(1, 40) for t, g in [("der die das und nicht" if i % 2 else "the of and not is", "de" if i % 2 else "en")]] + [(None, "x", "fr"), (50, None, "en"), (51, "y", None)], "doc_id bigint, text string, lang string")
    got = dict((i, (g, s)) for i, g, s in pairs(identify_language(odd, train), "lang_pred", "score"))
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[6][0] == got[7][0] == got[8][0] in ("de", "en") and 0 < got[6][1] <= 1
    assert got[7][1] == pytest.approx(got[6][1], abs=1e-6) and got[8][1] == pytest.approx(got[6][1], abs=1e-6)
    sure = spark.createDataFrame([(1, "und die der"), (2, "and the of")], "doc_id bigint, text string")
    assert [g for _, g in pairs(identify_language(sure, train), "lang_pred")] == ["de", "en"]
    assert {g for _, g in pairs(identify_language(odd, train.where("false")), "lang_pred")} == {"und"}


def test_language_model(odd):
    want = {i: x for (i, _), x in zip(ROWS, kneser_ney([t for _, t in ROWS], [t for _, t in ROWS]))}
    for i, n, known, total, base, score in pairs(score_texts(odd, odd), "n_tokens", "n_known", "train_tokens", "base_score", "score"):
        assert (n, known) == want[i][:2] and total == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for _, t in ROWS)
        assert base == pytest.approx(want[i][2], rel=1e-9) and score == pytest.approx(want[i][3], rel=1e-6)
    assert {(n, base, score) for _, n, base, score in pairs(score_texts(odd.where("doc_id < 3"), odd.where("false")), "n_tokens", "base_score", "score")} == {(1, 0.0, 0.0)}


def test_bpe(odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    both = decode(encode(odd.withColumn("ids", F.lit("in the way")), path), path, out="kept")
    assert both.columns == [c for c in odd.columns if c != "kept"] + ["ids", "kept"]
    texts = sorted(((i, t or "") for i, t in ROWS), key=lambda r: (r[0] is None, r[0] or 0))
    assert [(i, ids, back) for i, ids, back in pairs(both, "ids", "kept")] == [(i, t.encode(x, add_special_tokens=False).ids, x) for i, x in texts]


def test_lines(odd):
    out = drop_repeated_chunks(odd.withColumn("n_lines", F.lit("in the way")))
    assert out.columns == [*odd.columns, "n_lines", "n_removed"]
    got = pairs(out, "text", "n_lines", "n_removed")
    by = {i: r for i, *r in got}
    assert by[1] == [None, 0, 0] and by[2] == ["", 0, 0] and by[3] == ["  \n", 2, 0]
    # the long line goes from both rows of the identifier that repeats it, the short ones are no passages
    assert by[4][1:] == [1, 0] and [r[1:] for r in got if r[0] == 5] == [("", 1, 1)] * 2 and by[8] == ["short", 1, 0]


def test_decontamination(spark, odd):
    item = spark.createDataFrame([("b", "SHORT"), ("a", "short"), ("a", "short"), ("c", ""), ("d", None), (None, "short"), ("e", "a null identifier")], "item_id string, text string")
    got = {i: (n, hit, items) for i, n, hit, items in pairs(benchmark_hits(odd, item), "n_words", "n_hit", "items")}
    assert got[1] == got[2] == got[3] == (0, 0, []) and got[4][0] == 30_000
    assert got[6] == got[7] == got[8] == (1, 1, ["a", "b"]) and got[None] == (3, 3, ["e"])


def test_exact_and_near_ignore_other_columns(odd):
    assert exact_groups(odd).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert near_duplicates(odd).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_huge_texts(spark, labels):
    """Two copies of a text far above the size of a group, and one with a change, beside short ones."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    changed, n = HUGE.replace("w1 ", "v1 ", 1), 14_000 * 20
    texts = {1: HUGE, 2: "short", 3: HUGE, 4: changed, 5: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(2)
    assert len(HUGE) > 1 << 20
    assert pairs(exact_groups(docs), "keep_id", "group_size") == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1), (5, 5, 1)]
    assert pairs(near_duplicates(docs, shingle=2), "component_id") == [(1, 1), (2, 2), (3, 1), (4, 1), (5, 5)]
    words = pairs(repeated_passages(docs), "n_words", "n_removed")
    assert words == [(1, n, 0), (2, 1, 0), (3, n, n), (4, n, n - 1), (5, 0, 0)]
    left = pairs(drop_repeated_chunks(docs), "n_removed")
    assert left[0] == (1, 0) and left[2] == (3, 14_000) and left[3][1] >= 13_997
    item = spark.createDataFrame([("a", " ".join(HUGE.split()[-10:]))], "item_id string, text string")
    assert [r[1:] for r in pairs(benchmark_hits(docs, item), "n_words", "n_hit")] == [(n, 10), (1, 0), (n, 10), (n, 10), (0, 0)]
    assert [r[1] for r in pairs(decode(encode(docs, path), path), "decoded")] == [t or "" for t in texts.values()]
    tokens = pairs(score_texts(docs, docs), "n_tokens", "score")
    assert [t for _, t, _ in tokens] == [n + 1, 2, n + 1, n + 1, 1] and tokens[0][2] == pytest.approx(tokens[2][2])
    for out in (score_toxicity(docs, labels), score_quality(docs, labels)):
        scores = dict(pairs(out, "score"))
        assert scores[1] == scores[3] and len(scores) == 5
    got = dict(pairs(identify_language(docs, docs.withColumn("lang", F.lit("en"))), "lang_pred"))
    assert got == {1: "en", 2: "en", 3: "en", 4: "en", 5: "und"}
