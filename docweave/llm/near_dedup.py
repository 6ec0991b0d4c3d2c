"""Near-duplicate documents by a chosen-path set similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .components import components
from .shared import id_and_text, shards_for, stored, workspace
from .textkernel import LOWER, U, groups, mix, split, text_array, window_hashes, word_hashes

#: Minwise values of a sketch, of which one byte each is kept.
WIDTH = 64
#: Independent trees; branches of a node; minwise tokens that a branch selects; levels.
TREES, BRANCHES, TOKENS, LEVELS = 3, 4, 2, 3
#: Nodes up to this size are compared exhaustively, at most so many cells of their matrices at once.
SMALL, CELLS = 128, 1 << 18
#: Documents of a cluster that are verified together.
BLOCK = 128
#: Documents of a cluster among which its centre is chosen.
DRAWN = 64
#: Rows of a cluster from which its middle is taken.
VOTERS = 64
#: Pairs a loose document that a cluster's join may look at, where a further round could join some of them first.
HEAVY = 2048

_SEEDS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each document's sorted set of k-word shingle hashes; with fewer words one for all of them."""
    words = split(LOWER[data], offsets)
    h = word_hashes(words)
    windows = window_hashes(h, k)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            x = np.sort(windows[a : b - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        else:
            out.append(mix(window_hashes(h[a:b], b - a) + U(b - a)) if b > a else h[a:a])
    return out


def sketch(own: np.ndarray) -> np.ndarray:
    """One byte of each minwise value of a set."""
    out = np.empty(WIDTH, np.uint64)
    for i in range(0, len(own), 4096):
        low = (own[i : i + 4096, None] * _SEEDS).min(axis=0)
        out = np.minimum(out, low) if i else low
    return (mix(out) >> U(56)).astype(np.uint8)


def _fixed(column: pa.Array) -> np.ndarray:
    """The sketches of a column as a matrix."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1 + column.offset)[column.offset :]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(len(column), WIDTH) if len(column) else np.zeros((0, WIDTH), np.uint8)


def _agreements(sig: np.ndarray) -> np.ndarray:
    """Of each node (nodes x members x WIDTH), how many values each two members have in common."""
    out = np.zeros((sig.shape[0], sig.shape[1], sig.shape[1]), np.uint8)
    for i in range(WIDTH):
        value = sig[:, :, i]
        out += value[:, :, None] == value[:, None, :]
    return out


def _least_connected(met: np.ndarray) -> np.ndarray:
    """The first member that each member of a node is connected with, over any number of steps."""
    n = met.shape[1]
    low = np.broadcast_to(np.arange(n, dtype=np.int16), met.shape[:2])
    while True:
        new = np.where(met, low[:, None, :], np.int16(n)).min(axis=2, initial=n).astype(np.int16)
        new = np.minimum(new, low)
        if (new == low).all():
            return low
        low = new


def _children(path: np.ndarray, sig: np.ndarray) -> Iterator[np.ndarray]:
    """The nodes below, one array per branch: each node picks its own minwise tokens."""
    row = np.arange(len(path))
    for i in range(BRANCHES):
        step = mix(path + U((i + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        node, pick = step.copy(), step
        for _ in range(TOKENS):
            at = pick % U(WIDTH)
            node = mix(node ^ ((at << U(8)) | sig[row, at.astype(np.int64)].astype(np.uint64)))
            pick = mix(pick + U(1))
        yield node


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The branches of each tree's root."""
    for batch in batches:
        sig = _fixed(batch.column("sig"))
        for t in range(TREES):
            for node in _children(np.full(batch.num_rows, mix(np.array([t + 1], np.uint64))[0]), sig):
                yield pa.record_batch([pa.array(node.view(np.int64)), batch.column("rep"), batch.column("sig")], names=["path", "rep", "sig"])


def _large(batches: Iterator[pa.RecordBatch], around: int, close: int) -> Iterator[pa.RecordBatch]:
    """Of large nodes: edges (lead, rep), without a sketch; and the rows that branch on, without a lead."""
    names = ["path", "rep", "sig", "lead"]
    for batch in batches:
        sig, rep, lead = _fixed(batch.column("sig")), batch.column("rep"), batch.column("lead")
        same = (sig == _fixed(batch.column("lead_sig"))).sum(axis=1)
        other = rep.to_numpy() != lead.to_numpy()
        hang, go = pa.array(other & (same >= around)), other & (same < close)
        n = int(hang.to_numpy(zero_copy_only=False).sum())
        yield pa.record_batch([pa.nulls(n, pa.int64()), rep.filter(hang), pa.nulls(n, pa.binary()), lead.filter(hang)], names=names)
        reps, sigs, m = rep.filter(pa.array(go)), batch.column("sig").filter(pa.array(go)), int(go.sum())
        for node in _children(batch.column("path").to_numpy()[go].view(np.uint64), sig[go]):
            yield pa.record_batch([pa.array(node.view(np.int64)), reps, sigs, pa.nulls(m, pa.int64())], names=names)


def _centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the members drawn from each cluster the one that resembles the others most."""
    for batch in batches:
        members = batch.column("members")
        at, ids, sig = members.offsets.to_numpy(), members.values.field("id").to_numpy(), _fixed(members.values.field("sig"))
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            order = a + np.argsort(ids[a:b], kind="stable")
            out.append(int(ids[order[_agreements(sig[None, order])[0].sum(axis=1, dtype=np.int64).argmax()]]))
        yield pa.record_batch([batch.column("component"), pa.array(out, pa.int64())], names=["component", "centre"])


def _prefixes(m: int, n: int, percent: int) -> tuple[int, int]:
    """How many of the ``m`` values by which a set of ``n`` differs from the middle must hold a common one with a linked set: with one that differs in as many or more, and with one that differs in as many or fewer.

    Linked sets A and B differ in no more than t (|A| + |B|) values, t = (100 - percent) / (100 + percent), so their
    differences a and b from any third set have (|a| + |b| - t (|A| + |B|)) / 2 values in common: |a| - t (|A| + |B|) / 2
    or more where |b| >= |a|, and |a| - t (|A| + |B|) or more in any case. The larger set is at most 100 / percent of the smaller one.
    """
    return min(m, (100 - percent) * n // (2 * percent) + 1), min(m, (100 - percent) * n // percent + 1)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of ``percent`` hundredths or more.

    A-Z is lower-cased; words are ``[^\\x20\\x09-\\x0D]+``. A set holds the
    distinct ``shingle``-word shingles, or the whole sequence if there are fewer
    words; a text without words has an empty set and is linked with nothing.

    Equal sets form a class, and one document stands for it. Candidates come from
    ``TREES`` chosen-path trees: at a node, each of ``BRANCHES`` branches selects
    ``TOKENS`` minwise tokens, and documents that agree on them go on together.
    All trees and branches draw from the same ``WIDTH`` minwise values, so their
    misses aren't independent. Simulated with these trees on 2 million pairs whose
    values agree with a probability of 0.8, a pair has no common node below a root
    with 3.6e-5, none at the second level with 9e-5 and none at the third with
    1.2e-4; the latter two count where all nodes that it shares above are large.
    Others part. A node of up to ``SMALL`` documents is
    compared exhaustively by sketch. In a larger one, whatever resembles its
    smallest document is hung below that, and what is very close to it needs no
    further branching: all that could be linked with it resembles that document
    too. So a huge group of near copies ends in its first node and gives one row
    for each document.

    The candidates' clusters are then verified on whole sets, in blocks of
    ``BLOCK`` documents which all hold the cluster's centre, the smallest document
    of a small cluster. Documents known to be connected are not compared again.
    A document that isn't connected with the centre is loose. A cluster with such
    documents has a middle: the centre's set, changed in the values by which most
    documents differ from it. Sets that are together so near to the middle that
    they must be linked are all linked with the nearest one. Two other linked sets
    differ from the middle in common values, and the rarest values of each
    difference hold one of them (``_prefixes``), so an exact prefix-filtered join
    finds them. No pair of a cluster that could link two components is left out,
    and no loose document goes to every block. Where documents that are not
    connected with the middle share so many rare values that the join among them
    would grow with the square of their number, they form a cluster with a centre
    of its own in a further round.

    Rows without identifier are linked with nothing; rows that repeat an
    identifier count as one document. Other columns are ignored; an empty table
    gives an empty result.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    space, shards = workspace(spark, "near"), shards_for(texts, 64 << 20)
    # agreements of two sketches: what may be linked, and how near to a node's first document ends branching
    maybe = round(WIDTH * percent / 100 - 15.2 * WIDTH / 64)
    close = round(WIDTH * percent / 100 + 1)
    around = max(1, round(WIDTH * (2 * percent / 100 - 1) - 12))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in groups(text_array(batch.column("text"))):
                sets = shingle_sets(data, offsets, shingle)
                one = np.array([np.bitwise_xor.reduce(x) if len(x) else 0 for x in sets], np.uint64)
                two = np.array([mix(x).sum() if len(x) else 0 for x in sets], np.uint64)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([sketch(x).tobytes() if len(x) else None for x in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "d1", "d2", "sig"],
                )

    key = ["n_shingles", "d1", "d2"]
    all_docs = stored(texts.mapInArrow(sketches, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary"), f"{space}/sketches")
    reps = stored(all_docs.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), f"{space}/classes")
    # an identifier that rows repeat may stand for several classes; they are one document
    nodes = reps.select("rep", "sig")

    row_schema = "path bigint, rep bigint, sig binary"
    pair_schema = "a bigint, b bigint"
    found: list[DataFrame] = []

    def exhaustive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            size = np.diff(members.offsets.to_numpy())
            start = members.offsets.to_numpy()[:-1]
            flat = members.values
            ids, sig = flat.field("rep").to_numpy(), _fixed(flat.field("sig"))
            for s in np.unique(size):
                of = start[size == s]
                for at in range(0, len(of), max(1, CELLS // (s * s))):
                    rows = of[at : at + max(1, CELLS // (s * s)), None] + np.arange(s)
                    # the least member that each is connected with; a link a member says the same as all pairs
                    low = _least_connected(_agreements(sig[rows]) >= maybe)
                    node, member = np.nonzero(low != np.arange(s))
                    yield pa.record_batch([pa.array(ids[rows[node, member]]), pa.array(ids[rows[node, low[node, member]]])], names=["a", "b"])

    rows = nodes.mapInArrow(_roots, row_schema)
    for level in range(1, LEVELS + 1):
        counts = stored(rows.groupBy("path").agg(F.count("*").alias("n"), F.min("rep").alias("lead")).where("n > 1"), f"{space}/nodes{level}")
        small = counts.where(F.col("n") <= SMALL).select("path")
        met = rows.join(small, "path").groupBy("path").agg(F.collect_list(F.struct("rep", "sig")).alias("members"))
        found.append(stored(met.select("members").mapInArrow(exhaustive, pair_schema), f"{space}/pairs{level}"))
        # the classes of a repeated identifier may join more than once, which changes nothing
        big = counts.where(F.col("n") > SMALL).select("path", "lead").join(nodes.select(F.col("rep").alias("lead"), F.col("sig").alias("lead_sig")), "lead")
        if level == LEVELS:
            # nothing is compared any more: whatever met here is a candidate
            found.append(rows.join(big.select("path", "lead"), "path").select(F.col("rep").alias("a"), F.col("lead").alias("b")))
        else:
            both = stored(rows.join(big, "path").mapInArrow(lambda it: _large(it, around, close), "path bigint, rep bigint, sig binary, lead bigint"), f"{space}/rows{level + 1}")
            found.append(both.where("lead IS NOT NULL").select(F.col("rep").alias("a"), F.col("lead").alias("b")))
            rows = both.where("lead IS NULL").select("path", "rep", "sig")
            if not rows.take(1):
                break

    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    clusters = stored(components(edges, f"{space}/loose"), f"{space}/clusters")
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = runs.RunMaker(shards, ["min", "min", "min"])
        for batch in batches:
            ids, cluster, size = (batch.column(c).to_numpy() for c in ("id", "component", "size"))
            yield from out.add(mix(ids.view(np.uint64)), ids, cluster, size)
        yield from out.flush()

    def members(of: DataFrame, path: str) -> runs.Store:
        """Each document's cluster, by its centre, and that cluster's size."""
        sizes = of.groupBy("component").agg(F.count("*").alias("size"))
        drawn = of.join(sizes.where(F.col("size") > BLOCK), "component").join(nodes, F.col("id") == F.col("rep"))
        drawn = drawn.groupBy("component", F.pmod(F.xxhash64("id"), F.lit(DRAWN)).alias("draw")).agg(F.min(F.struct("id", "sig")).alias("one"))
        centres = drawn.groupBy("component").agg(F.collect_list("one").alias("members")).mapInArrow(_centre, "component bigint, centre bigint")
        rows = of.join(sizes, "component").join(centres, "component", "left").select("id", F.coalesce("centre", "component").alias("component"), "size")
        return runs.build(rows.mapInArrow(index, runs.RUN_SCHEMA), path, shards, ["min", "min", "min"])[0]

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        if len(x) > len(y):
            x, y = y, x
        if len(x) * 100 < percent * len(y):
            return False
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int((y[at] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    def verified(member: runs.Store, path: str) -> DataFrame:
        """Links found in blocks; in clusters of several, also by what each set differs from the centre's."""
        names = ["cluster", "block", "doc", "every", "many", "own"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]

        def _rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids_all, valid = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                found, (_, cluster_all, size_all) = member.lookup(mix(ids_all.view(np.uint64)))
                at = np.flatnonzero(found & valid)
                if not len(at):
                    continue
                some = text_array(batch.column("text").take(pa.array(at)))
                for a, b, data, offsets in groups(some):
                    out: list[tuple] = []
                    for row, own in zip(at[a:b].tolist(), shingle_sets(data, offsets, shingle), strict=True):
                        blocks, every = -(-int(size_all[row]) // BLOCK), bool(ids_all[row] == cluster_all[row])
                        mine = int(mix(np.array([ids_all[row]], np.int64).view(np.uint64) + U(7))[0] % U(blocks))
                        for block in range(blocks) if every else (mine,):
                            out.append((int(cluster_all[row]), block, int(ids_all[row]), every, blocks > 1, own.tobytes()))
                            if len(out) >= 2000:
                                yield _rows(out)
                                out = []
                    yield _rows(out)

        def settle(rows: list[tuple]) -> list[int]:
            """Join components of a block; pairs inside a component are not compared. Gives each row's smallest document."""
            sets, roots = [np.frombuffer(r[5], np.uint64) for r in rows], [r[2] for r in rows]
            group: dict[int, list[int]] = {}
            for i, label in enumerate(roots):
                # rows of one document are one, whatever their texts
                again = i and rows[i - 1][2] == label
                hits = [g for g, some in group.items() if g != label and ((again and i - 1 in some) or any(linked(sets[m], sets[i]) for m in some))]
                into = min([label, *hits])
                joined = [i]
                for g in {*hits, label}:
                    joined += group.pop(g, [])
                group[into] = joined
            for root, some in group.items():
                for m in some:
                    roots[m] = root
            return roots

        def settled(rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[2], len(r[5]), r[5]))
            centre = next((np.frombuffer(r[5], np.uint64) for r in rows if r[3]), None)
            out = []
            for i, (r, root) in enumerate(zip(rows, settle(rows), strict=True)):
                told = (None,) * 4
                # the centre's other rows, where it has some, are told once
                if r[4] and not (r[3] and r[1]):
                    own = np.frombuffer(r[5], np.uint64)
                    told = (i, len(own), len(centre), np.setxor1d(own, centre, assume_unique=True).tobytes())
                if told[0] is not None or not i or r[2] != rows[i - 1][2]:
                    out.append((r[0], r[2], root, r[4], *told))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["cluster", "doc", "root", "many", "row", "n", "d", "apart"])

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []
            for batch in batches:
                for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                    if row[:2] != key:
                        if held:
                            yield settled(held)
                        key, held = row[:2], []
                    held.append(row)
            if held:
                yield settled(held)

        dealt = texts.mapInArrow(deal, "cluster bigint, block int, doc bigint, every boolean, many boolean, own binary")
        met = dealt.repartition("cluster", "block").sortWithinPartitions("cluster", "block")
        return stored(met.mapInArrow(check, "cluster bigint, doc bigint, root bigint, many boolean, row bigint, n bigint, d bigint, apart binary"), path)

    def value_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """A key of each value of the differences, by cluster, and where each row's begin."""
        apart = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("apart")]
        size = np.array([len(x) for x in apart], np.int64)
        cluster = mix(batch.column("cluster").to_numpy().view(np.uint64) + U(3))
        return mix(np.concatenate([*apart, np.zeros(0, np.uint64)]) ^ np.repeat(cluster, size)), np.concatenate(([0], np.cumsum(size)))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = runs.RunMaker(shards, ["sum"])
        for batch in batches:
            keys, _ = value_keys(batch)
            yield from out.add(keys, np.ones(len(keys), np.int64))
        yield from out.flush()

    def across(open_rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
        """Links that connect components of a cluster, and the documents that need a further round."""
        often, _ = runs.build(open_rows.mapInArrow(occurrences, runs.RUN_SCHEMA), f"{path}-often", shards, ["sum"])

        sizes = open_rows.groupBy("cluster").agg(F.count("*").alias("rows"))

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, at = value_keys(batch)
                most = 2 * often.lookup(keys, [0])[1][0] > np.repeat(batch.column("rows").to_numpy(), np.diff(at))
                cluster = np.repeat(batch.column("cluster").to_numpy(), np.diff(at))
                yield pa.record_batch([pa.array(cluster[most]), pa.array(keys[most].view(np.int64))], names=["cluster", "value"])

        # a value of most rows is in one of these; any set would do for a middle
        voters = open_rows.join(sizes, "cluster").where(F.pmod(F.xxhash64("doc", "row"), F.greatest(F.lit(1), F.floor(F.col("rows") / VOTERS))) == 0)
        flips = stored(voters.mapInArrow(frequent, "cluster bigint, value bigint").groupBy("cluster").agg(F.collect_set("value").alias("flips")), f"{path}-middle")

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, at = value_keys(batch)
                flips = [np.sort(np.array(x or [], np.int64).view(np.uint64)) for x in batch.column("flips").to_pylist()]
                own = [np.setxor1d(keys[a:b], x, assume_unique=True) for a, b, x in zip(at[:-1], at[1:], flips, strict=True)]
                cut = np.cumsum([len(x) for x in own])[:-1]
                all_times = np.split(often.lookup(np.concatenate([*own, np.zeros(0, np.uint64)]), [0])[1][0], cut)
                ms, short, values, ranks = [], [], [], []
                for x, times, middle, n, rows in zip(own, all_times, flips, *(batch.column(c).to_pylist() for c in ("n", "rows")), strict=True):
                    many = np.where(np.isin(x, middle, assume_unique=True), rows - times, times)
                    few, most = _prefixes(len(x), n, percent)
                    order = np.lexsort((x, many))[:most]
                    rank = np.flatnonzero(many[order] > 1)
                    ms.append(len(x))
                    short.append(few)
                    values.append(x[order[rank]].view(np.int64))
                    ranks.append(rank)
                some = ("cluster", "doc", "row", "label", "loose", "n")
                yield pa.record_batch([*(batch.column(c) for c in some), pa.array(ms, pa.int64()), pa.array(short, pa.int64()), pa.array(values, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int64()))], names=[*some, "m", "short", "value", "rank"])

        moved = open_rows.join(sizes, "cluster").join(flips, "cluster", "left")
        sets = stored(moved.mapInArrow(mark, "cluster bigint, doc bigint, row bigint, label bigint, loose boolean, n bigint, m bigint, short bigint, value array<bigint>, rank array<bigint>"), f"{path}-sets")
        # two sets whose slacks aren't negative together differ in no more than linked ones may
        sets = sets.withColumn("slack", (100 - percent) * F.col("n") - (100 + percent) * F.col("m"))
        best = sets.groupBy("cluster").agg(F.max(F.struct("slack", "doc")).alias("best"))
        sets = sets.join(best, "cluster").withColumn("core", (F.col("best.slack") >= 0) & (F.col("slack") + F.col("best.slack") >= 0))
        near_middle = sets.where("core").select(F.col("doc").alias("a"), F.col("best.doc").alias("b"))
        # what is connected with the set nearest to the middle, or else with the centre; pairs of it need no look
        hub = sets.where("core OR (best.slack < 0 AND NOT loose)").select("cluster", "label", F.lit(True).alias("hub")).distinct()
        sets = stored(sets.join(hub, ["cluster", "label"], "left").withColumn("hub", F.coalesce("hub", F.lit(False))).drop("best", "slack", "core"), f"{path}-hub")
        marks = sets.select("cluster", "doc", "row", "label", "hub", "n", "m", "short", F.explode(F.arrays_zip("value", "rank")).alias("at"))
        marks = stored(marks.select("cluster", "doc", "row", "label", "hub", "n", "m", "at.value", "at.rank", (F.col("at.rank") < F.col("short")).alias("first")), f"{path}-marks")
        # a further round helps where some of the documents are connected
        loose = F.sum((~F.col("hub")).cast("long"))
        some = sets.groupBy("cluster").agg(loose.alias("loose"), F.count("*").alias("all")).where((F.col("loose") > BLOCK) & (F.col("loose") * 10 < F.col("all") * 9))
        work = marks.where("NOT hub AND first").groupBy("cluster", "value").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.sum(F.col("c") * F.col("c")).alias("work"))
        heavy = stored(work.join(some, "cluster").where(F.col("work") > HEAVY * F.col("loose")).select("cluster"), f"{path}-heavy")
        light = marks.where("NOT hub").join(heavy, "cluster", "left_anti")
        pairs = None
        for x, y in ((marks.where("hub AND first"), marks.where("NOT hub")), (marks.where("NOT hub AND first"), marks.where("hub").unionByName(light))):
            fewer = (F.col("x.m") < F.col("y.m")) | ((F.col("x.m") == F.col("y.m")) & (F.col("x.label") < F.col("y.label")))
            alike = (100 * F.col("x.n") >= percent * F.col("y.n")) & (100 * F.col("y.n") >= percent * F.col("x.n"))
            # from a common value on, both have enough left for what a link of these two must have in common
            left = F.least(F.col("x.m") - F.col("x.rank"), F.col("y.m") - F.col("y.rank"))
            near = 2 * (100 + percent) * left >= (100 + percent) * (F.col("x.m") + F.col("y.m")) - (100 - percent) * (F.col("x.n") + F.col("y.n"))
            same = (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.value") == F.col("y.value"))
            met = x.alias("x").join(y.alias("y"), same & (F.col("x.label") != F.col("y.label")) & fewer & alike & near).select("x.cluster", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("doc", "row")))
            pairs = met if pairs is None else pairs.unionByName(met)
        pairs = pairs.distinct()
        for s in "xy":
            pairs = pairs.join(open_rows.select("cluster", F.col("doc").alias(f"{s}_doc"), F.col("row").alias(f"{s}_row"), F.col("n").alias(f"{s}_n"), F.col("apart").alias(f"{s}_apart")), ["cluster", f"{s}_doc", f"{s}_row"])

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = []
                for n, x, m, y in zip(*(batch.column(c) for c in ("x_n", "x_apart", "y_n", "y_apart")), strict=True):
                    total, apart = n.as_py() + m.as_py(), len(np.setxor1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
                    # a total less twice what is common is what the sets differ in
                    ok.append(100 * (total - apart) >= percent * (total + apart))
                keep = pa.array(ok, pa.bool_())
                yield pa.record_batch([batch.column("x_doc").filter(keep), batch.column("y_doc").filter(keep)], names=["a", "b"])

        found = stored(pairs.mapInArrow(confirm, pair_schema).unionByName(near_middle), f"{path}-links")
        return found, sets.where("NOT hub").join(heavy, "cluster", "left_semi").select(F.col("doc").alias("id"), F.col("cluster").alias("component")).distinct()

    links, todo, turn = None, clusters, 1
    while True:
        first = verified(members(todo, f"{space}/members{turn}"), f"{space}/blocks{turn}")
        # what a further round links belongs to a cluster of several blocks, whatever it has now
        own = first.select(F.col("doc").alias("a"), F.col("root").alias("b"), "many" if turn == 1 else F.lit(True).alias("many"))
        links = own if links is None else links.unionByName(own)
        several = first.where("many")
        if not several.where("doc <> cluster").take(1):
            break
        labels = components(several.select(F.col("doc").alias("a"), F.col("root").alias("b")), f"{space}/known{turn}")
        told = several.where("apart IS NOT NULL").join(labels.select(F.col("id").alias("doc"), F.col("component").alias("label")), "doc", "left")
        told = told.join(labels.select(F.col("id").alias("cluster"), F.col("component").alias("centre")), "cluster", "left")
        told = told.withColumn("label", F.coalesce("label", "doc")).withColumn("loose", F.col("label") != F.coalesce("centre", "cluster"))
        told = stored(told.select("cluster", "doc", "row", "n", "d", "apart", "label", "loose"), f"{space}/told{turn}")
        # clusters with more than one component
        open_rows = told.join(told.where("loose").select("cluster").distinct(), "cluster", "left_semi")
        if not open_rows.take(1):
            break
        more, rest = across(open_rows, f"{space}/across{turn}")
        links = links.unionByName(more.select("a", "b", F.lit(True).alias("many")))
        todo, turn = rest, turn + 1
        if not todo.take(1):
            break
    # a cluster of one block is settled; blocks of one cluster meet in their components
    several = links.where("many").select("a", "b")
    settled = links.where("NOT many").select(F.col("a").alias("id"), F.col("b").alias("component"))
    final = settled.unionByName(components(several, f"{space}/linked")) if several.take(1) else settled
    classes = reps.join(final, F.col("rep") == F.col("id"), "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    classes = stored(classes, f"{space}/result")
    out = all_docs.select("doc_id", *key).join(classes, key, "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
