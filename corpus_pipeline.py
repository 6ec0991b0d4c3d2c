"""The corpus pipeline: five operators in sequence over documents.

Each stage is a function of (spark, docs, sf_dir). ``run`` writes each stage's
rows as Parquet and rereads them as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.bpe import encode
from docweave.llm.decontaminate import benchmark_hits
from docweave.llm.lines import drop_repeated_chunks
from docweave.llm.near_dedup import near_duplicates
from docweave.llm.quality import score_quality
from docweave.llm.shared import stored, workspace

#: A document whose quality score is lower goes.
LEAST_QUALITY = 0.7
#: A document with windows of so many benchmark items goes, and one with so many consecutive words of any.
MOST_ITEMS, LONGEST_RUN = 2, 13


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), append=True)
    return scored.where(F.col("score") >= LEAST_QUALITY).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated chunks of lines; n_chars follows the text. A document of which nothing but white space is left goes."""
    cut = drop_repeated_chunks(docs)
    cut = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest identifier of each group of near duplicates."""
    gone = near_duplicates(docs, shingle=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold windows of several benchmark items, or a passage longer than a chance match."""
    hits = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), append=True)
    longest = F.array_max(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x - F.get("spans", i - 1)).otherwise(0)))
    return hits.where((F.size("items") < MOST_ITEMS) & (F.coalesce(longest, F.lit(0)) < LONGEST_RUN)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left; returns doc_id, n_tokens and ids."""
    import public_tokenizers

    coded = encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("bpe", tokens)]

#: The classifier and the chunk boundaries have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{space}/{i}-{name}")
    return docs
