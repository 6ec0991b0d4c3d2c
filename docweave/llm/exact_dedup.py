"""Exact deduplication by tree-merging sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, input_bytes, stored, workspace

#: Runs at the leaves of the merge tree: so many, doubled until a run stands for no more bytes of input than this.
RUNS, BYTES_A_RUN = 16, 32 << 30
KEY = ("digest", "check", "length")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose texts are equal without white space.

    The text loses every character of ``[\\x20\\x09-\\x0D]`` and is then
    digested. Rows fall into ``RUNS`` runs by identifier, into more where the input
    is larger. Each run is reduced to one entry a digest; then, in binomial rounds,
    the upper half of the runs is merged into the lower half until one is left. A
    run is spread over many tasks, so no round gathers one in a task. An entry keeps the number of rows and the best row: most code points in
    the original text, then the smallest identifier. The aggregates are structs,
    which Spark merges with sort-based aggregation, so every level merges runs
    sorted by digest. Entries meet only if SHA-256, a second 64-bit hash and the
    byte length all agree, at every level. Equal texts shrink to one entry a task
    before the first exchange, so a group that holds a third of all rows moves
    few entries.

    Null text counts as empty. A null identifier sorts after all others. If rows
    repeat an identifier and a text, exactly one of them is kept. An empty table
    gives an empty result. Columns besides the two named are ignored.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row.
    """
    spark = docs.sparkSession
    space = workspace(spark, "exact")
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = stored(
        id_and_text(docs, id_col, text_col)
        .select("doc_id", F.char_length(text).alias("chars"), F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").alias("norm"))
        .select(
            "doc_id",
            "chars",
            F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
            F.xxhash64("norm").alias("check"),
            F.octet_length("norm").alias("length"),
            F.monotonically_increasing_id().alias("row"),
        ),
        f"{space}/digests",
    )
    count, size = RUNS, input_bytes(id_and_text(docs, id_col, text_col))
    while count * BYTES_A_RUN < size:
        count *= 2
    best = F.struct((-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    runs = digests.select(*KEY, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(count)).cast("int").alias("run"), best.alias("best"), F.lit(1).cast("long").alias("n"))
    while True:
        runs = runs.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        if count == 1:
            break
        count //= 2
        runs = runs.withColumn("run", F.pmod("run", F.lit(count)))
    # unique texts need no partner; only true groups are joined back
    found = stored(runs.where("n > 1").select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n"), f"{space}/groups")
    joined = digests.join(found, list(KEY), "left")
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
