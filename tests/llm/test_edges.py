"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from docweave.llm import near_dedup, quality, runs
from docweave.llm.bpe import Codec, decode, encode
from docweave.llm.decontaminate import benchmark_hits
from docweave.llm.exact_dedup import exact_groups
from docweave.llm.kneser_ney import score_texts
from docweave.llm.language_id import identify_language
from docweave.llm.lines import drop_repeated_chunks
from docweave.llm.near_dedup import near_duplicates
from docweave.llm.quality import score_quality
from docweave.llm.substrings import repeated_passages
from docweave.llm.textkernel import mix
from docweave.llm.toxicity import score_toxicity

SCHEMA = "doc_id bigint, text string, lang string, score int, kept string, n_words int, path string, rep int"
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(random.Random(1).choices(WORDS, k=30_000))
ROWS = [(1, None), (2, ""), (3, "  \n"), (4, LONG), (5, LONG), (5, LONG), (None, "a null identifier"), (6, "short"), (7, "Short"), (8, "short"), (9, "\U0001f600 é ß 　 x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if i else None, 3, "k", 4, "p", 5) for i, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")


def by_id(out):
    return {r.doc_id: r for r in out.collect()}


def test_every_operator_on_odd_and_empty_tables(spark, odd, labels):
    item = spark.createDataFrame([("a", "short"), ("b", None), (None, "short"), ("a", "short")], "item_id string, text string")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    run = {
        "toxicity": lambda d: score_toxicity(d, labels),
        "quality": lambda d: score_quality(d, labels, append=True),
        "language": lambda d: identify_language(d, d.select("doc_id", "text", "lang")),
        "lm": lambda d: score_texts(d, d),
        "bpe": lambda d: decode(encode(d, path), path),
        "lines": drop_repeated_chunks,
        "near": near_duplicates,
        "passages": repeated_passages,
        "benchmark": lambda d: benchmark_hits(d, item, append=True),
        "exact": exact_groups,
    }
    for name, make in run.items():
        assert len(make(odd).collect()) == len(ROWS), name
        assert make(odd.where(F.lit(False))).collect() == [], name


def test_exact_groups_ties(odd):
    got = by_id(exact_groups(odd))
    assert [(r.keep_id, r.group_size) for r in (got[1], got[4], got[6], got[7])] == [(3, 3), (4, 3), (6, 2), (7, 1)]
    repeated = [r.kept for r in exact_groups(odd.where("doc_id = 5")).collect()]
    assert sorted(repeated) == [False, True]


def test_near_duplicates_ties(odd):
    got = by_id(near_duplicates(odd, shingle=2))
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 2, 3, 4, 4, 6, 6, 6]
    assert got[1].n_shingles == got[3].n_shingles == 0 and got[None].component_id is None and got[None].kept


def test_benchmark_hits_short_items(spark, odd):
    item = spark.createDataFrame([("a", "SHORT!"), ("b", "no"), ("c", None)], "item_id string, text string")
    got = by_id(benchmark_hits(odd, item))
    assert got[7]["items"] == ["a"] and got[7].n_hit == 1 and got[7].spans == [0, 1] and got[1].n_words == 0 and got[4]["items"] == []


def test_passages_keep_the_first(odd):
    got = by_id(repeated_passages(odd))
    assert got[4].n_removed == 0 and got[5].n_removed == 30_000 and got[5].kept == ""


def test_every_factor_copies_its_source(spark):
    """A factor's words stand at the named place of an earlier document; each repeated passage is one or more factors."""
    rnd = random.Random(11)
    passages = [rnd.choices(WORDS, k=20 + p) for p in range(12)]
    texts = {}
    for i in range(60):
        texts[i] = [w for _ in range(4) for w in (*(f"o{rnd.randrange(10**6)}" for _ in range(5)), *passages[rnd.randrange(12)][rnd.randrange(4) :])]
    out = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id bigint, text string").repartition(5))
    seen, n = {}, 0
    for r in sorted(out.collect(), key=lambda r: r.doc_id):
        own = texts[r.doc_id]
        windows = {k: tuple(own[k : k + 13]) for k in range(len(own) - 12)}
        want = {k + j for k, w in windows.items() if w in seen for j in range(13)}
        for f in r.factors:
            n += 1
            assert f.source < r.doc_id and f.end - f.begin >= 13 and own[f.begin : f.end] == texts[f.source][f.at : f.at + f.end - f.begin]
        assert {k for f in r.factors for k in range(f.begin, f.end)} == want and r.n_removed == len(want)
        for w in windows.values():
            seen.setdefault(w, r.doc_id)
    assert n > 100


def test_runs_are_merged_in_two_levels(spark, tmp_path):
    """More shards than runs a map task may make give the same table."""
    rng = np.random.default_rng(1)
    keys = mix(rng.integers(0, 3000, 20_000).astype(np.uint64))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys.view(np.int64).tolist())], "k bigint, v bigint").repartition(7)
    shards, how = 64, ["sum", "min", "max", "with"]

    def make(batches):
        out = runs.RunMaker(shards, how, spread=8)
        for b in batches:
            v = b.column("v").to_numpy()
            yield from out.add(b.column("k").to_numpy().view(np.uint64), np.ones(len(v), np.int64), v, v, v + 5)
        yield from out.flush()

    # the second column but one is the least value, and the last that beside the least of the first
    store, (n,) = runs.build(rows.mapInArrow(make, runs.RUN_SCHEMA), f"file://{tmp_path}/t", shards, how, summary=lambda k, c, *_: [c.sum()], n_sums=1, spread=8)
    found, (count, low, high, _) = store.lookup(np.append(keys, np.uint64(5)))
    assert n == len(keys) and found[:-1].all() and not found[-1] and store.size == len(np.unique(keys))
    want = {}
    for i, k in enumerate(keys.tolist()):
        want.setdefault(k, []).append(i)
    assert [(c, a, b) for c, a, b in zip(count, low, high)][:-1] == [(len(want[k]), want[k][0], want[k][-1]) for k in keys.tolist()]


def brute_components(texts, percent, shingle=2):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    root = {i: i for i in texts}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


def test_near_duplicates_in_a_large_group(spark):
    """A group far larger than a node and a block, some members near the threshold."""
    rnd = random.Random(5)
    base = rnd.choices(WORDS, k=60)
    texts = {}
    for i in range(260):
        own = list(base)
        for _ in range(rnd.choice((1, 2, 3, 6))):
            own[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
        texts[i] = " ".join(own)
    for i in range(260, 320):
        texts[i] = " ".join(rnd.choices(WORDS, k=60))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=2).collect()}
    assert got == brute_components(texts, 80)


def test_recall_of_candidates_in_large_nodes():
    """Pairs at the threshold, in large nodes down to the last level, with one sketch for all trees."""
    n, rng = 200_000, np.random.default_rng(3)
    left = rng.integers(0, 256, (n, near_dedup.WIDTH), dtype=np.uint8)
    right = np.where(rng.random(left.shape) < 0.8, left, rng.integers(0, 256, left.shape, dtype=np.uint8))
    fixed = lambda sig: pa.array([x.tobytes() for x in sig], pa.binary())
    sides = [pa.record_batch([pa.array(np.arange(n)), fixed(sig)], names=["rep", "sig"]) for sig in (left, right)]
    both = [pa.Table.from_batches(near_dedup._roots(iter([x]))) for x in sides]
    for level in range(1, near_dedup.LEVELS + 1):
        met = pc.equal(both[0]["path"], both[1]["path"])
        both = [x.filter(met).combine_chunks() for x in both]
        if level < near_dedup.LEVELS:
            m = both[0].num_rows
            # nothing resembles the node's first document, so that all go on
            far = {"lead": pa.array(np.full(m, -1)), "lead_sig": pa.array([bytes(near_dedup.WIDTH)] * m, pa.binary())}
            both = [pa.Table.from_batches(near_dedup._large(x.select(["path", "rep", "sig"]).append_column("lead", far["lead"]).append_column("lead_sig", far["lead_sig"]).to_batches(), 65, 65)) for x in both]
    assert 1 - len(both[0]["rep"].unique()) / n < 5e-4


def test_repeated_lines_go_and_the_first_stays(spark):
    """Chunks never differ from their lines: what is left is a subsequence, and a passage that all share is mostly cut."""
    shared = [f"shared line number {i}" for i in range(60)]
    rows = [(i, "\n".join([f"own {i} a", f"own {i} b", *shared, f"own {i} c"])) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = by_id(drop_repeated_chunks(docs))
    assert got[0].text == rows[0][1] and got[0].n_removed == 0
    for i in range(1, 6):
        left = got[i].text.split("\n")
        assert got[i].n_removed >= 48 and got[i].n_lines == 63 and len(left) == 63 - got[i].n_removed
        rest = iter(rows[i][1].split("\n"))
        assert all(line in rest for line in left) and {f"own {i} a", f"own {i} b", f"own {i} c"} <= set(left)


def test_short_passages_in_other_surroundings_go(spark):
    """Passages of two to five lines and single long ones, each planted in three documents between own lines."""
    passages = [[f"passage {p} line {k} of several" for k in range(2 + p % 4)] for p in range(40)] + [[" ".join(f"p{p}w{k}" for k in range(51))] for p in range(40, 50)]
    rows = [(i, "\n".join(x for p, lines in enumerate(passages) for x in [f"own {i} {p}", *lines, f"own {i} {p} after"])) for i in range(3)]
    rows += [(3, "same\nsame\nsame\nother"), (4, "lone 4\npassage 2 line 0 of several\nlone 4"), (5, "u\n\nv\nw\nu\n\nv")]
    got = by_id(drop_repeated_chunks(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)))
    assert got[0].text == rows[0][1]
    for i in (1, 2):
        assert got[i].text.split("\n") == [x for p in range(50) for x in (f"own {i} {p}", f"own {i} {p} after")]
    # what overlaps its first occurrence stays, and so does a single short line
    assert [got[i].text for i in (3, 4, 5)] == [rows[3][1], rows[4][1], "u\n\nv\nw"]


def test_quality_is_scaled_over_every_document(spark):
    """Only two documents have labels; the means are those of all."""
    texts = {i: " ".join(f"word{k}" for k in range(5 + i)) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    marks = spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, quality int")
    model = quality.fit(docs, marks)
    data = np.frombuffer("".join(texts.values()).encode(), np.uint8)
    stats = quality.statistics(data, np.concatenate(([0], np.cumsum([len(t) for t in texts.values()]))))
    assert np.allclose(model.mean, stats.mean(axis=0))
    assert np.allclose(model.scale, np.where(stats.std(axis=0) > 1e-9, stats.std(axis=0), 1.0))


def test_codec_on_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, c = Tokenizer.from_file(path), Codec(path)
    rnd = random.Random(3)
    marks = ["a", "zq", "É", "ß", " ", "  ", "\n", "\t", "'s", "1", "42", "　", "İ", "\U0001f600", "<|endoftext|>", "xj", "!?", "中文", "\x00"]
    texts = ["".join(rnd.choices(marks, k=rnd.randrange(60))) for _ in range(300)] + ["a" * 30_000, "zqxj" * 5_000, " " * 9_000, LONG]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert c.encode(x).tolist() == ids and c.decode(ids) == t.decode(ids, skip_special_tokens=False)
        assert [i for part in [c.encode(x)] for i in part] == ids
    # many short documents in one group
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(x.encode()) for x in texts])))
    ids, counts = c.encode_group(data, offsets)
    assert counts.tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert ids.tolist() == [i for x in texts for i in t.encode(x, add_special_tokens=False).ids]
    # a special token never spans two documents
    assert c.encode_group(np.frombuffer(b"<|endoftext|>", np.uint8), np.array([0, 5, 13]))[0].tolist() == t.encode("<|end", add_special_tokens=False).ids + t.encode("oftext|>", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a short text, two words", "Ещё один день", "ένα δύο τρία", "中文 和 日本語", "don't we'll x's"])
def test_cuts_are_certain_in_short_texts_of_any_alphabet(text):
    """Every cut parts bytes that no token holds together, and fragments give the ids of the whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, c, raw = Tokenizer.from_file(path), Codec(path), text.encode()
    cuts = [0, *c.cuts(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
    assert len(cuts) - 2 >= text.count(" ")
    for a in cuts[1:-1]:
        assert not any(raw[a - 1 : a + 1] in token for i, token in enumerate(c.token) if i not in c.special.values())
    assert [i for a, b in zip(cuts, cuts[1:], strict=False) for i in t.encode(raw[a:b].decode(), add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("heavy", [near_dedup.HEAVY, 0])
def test_loose_documents_of_a_large_group_are_not_dealt_to_every_block(spark, monkeypatch, heavy):
    """Copies with edits of their own, and pairs of such, are settled in rows that grow with the group, not with its square."""
    rnd, texts = random.Random(8), {}
    base = rnd.choices(WORDS, k=60)
    for i in range(700):
        own = list(base) if i < 600 else texts[rnd.randrange(500)].split(" ")
        for _ in range(rnd.choice((2, 4, 6, 7)) if i < 600 else 1):
            own[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
        texts[i] = " ".join(own)
    rows, store = [], near_dedup.stored

    def counted(df, path):
        out = store(df, path)
        if "root" in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    monkeypatch.setattr(near_dedup, "HEAVY", heavy, raising=False)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=2).collect()}
    want = brute_components(texts, 80)
    assert got == want and len(set(want.values())) > 100
    assert max(rows) < 2 * len(texts)


def test_join_of_copies_that_none_resembles_grows_with_the_group(spark, monkeypatch):
    """Where copies differ in too much to be linked, what most of them lack or share isn't joined, and links are still found."""
    rnd, texts = random.Random(9), {}
    base = rnd.choices(WORDS, k=60)
    for i in range(330):
        own = list(base) if i < 300 else texts[i - 300].split(" ")
        for _ in range(4 if i < 300 else 1):
            own[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
        texts[i] = " ".join(own)
    work, store = [], near_dedup.stored

    def counted(df, path):
        out = store(df, path)
        if {"value", "first"} <= set(out.columns):
            met = out.where("first").groupBy("cluster", "value").count()
            work.append(met.agg(F.sum(F.col("count") * F.col("count"))).first()[0])
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=2).collect()}
    want = brute_components(texts, 80)
    assert got == want and 200 < len(set(want.values())) < 330
    assert work and max(work) < 20 * len(texts)
