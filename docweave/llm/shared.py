"""Shared-folder tables and small helpers that all operators use."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor sees.

    Only where it is unset and Spark runs in this one process (tests, a laptop), a
    folder of this machine is taken; on a cluster that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docweave-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(uri: str) -> str:
    """The file-system path of a shared path, for files that workers map into memory."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped tables need spark.checkpoint.dir on a mounted file system, not {parts.scheme}://")
    return unquote(parts.path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: later
    plans start from files that outlive any executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, path: str, **sums: Column) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates over the rows that are taken while they are written."""
    seen = Observation()
    return stored(df.observe(seen, *(c.alias(k) for k, c in sums.items())), path), seen.get


#: Spark states a size of so many bytes or more where it knows none.
UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int:
    """The bytes that ``df`` (doc_id, text) reads: the length of its files, without a scan.

    Sizes of leaves are added up, as estimates above a join or a filter mean little.
    Where a leaf has no known size, as an RDD has none, the texts are measured.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if max(sizes, default=0) < UNKNOWN:
        return sum(sizes)
    return int(df.agg(F.sum(F.octet_length("text").cast("long") + 8)).first()[0] or 0)


def shards_for(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """A power of two that grows with the input, so that a shard's size does not."""
    n, size = 64, input_bytes(df)
    while n < 1 << 16 and n * bytes_each < size:
        n *= 2
    return n


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the identifier as text, modulo ``m``."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(m))


def held_out(col: Column, m: int, r: int) -> Column:
    """Rows never learnt from: crc32(id as text) mod m is r; a null id is not held out."""
    return F.coalesce(crc_mod(col, m) == r, F.lit(False))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
