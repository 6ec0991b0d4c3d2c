"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored_with


def components(edges: DataFrame, space: str) -> DataFrame:
    """The smallest identifier reachable from each end of the edges (columns a, b).

    Alternates large-star and small-star steps: each hangs the neighbours of a node
    below the smallest of them, until every component is a star. Only minima are
    aggregated, so a node with very many neighbours gathers no list, and its rows
    stand on the side of a join that adaptive execution can split. Every round is
    written to the shared folder. Loops and repeated edges don't matter.

    Returns id, component, one row per end.
    """
    # while a round is written, its rows are counted and their hashes added up: equal sums end the loop
    sums = {"n": F.count(F.lit(1)), "sign": F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))}
    tree, before = stored_with(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{space}/0", **sums)
    i = 0
    while before["n"]:
        i += 1
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tree, after = stored_with(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{space}/{i}", **sums)
        if after == before:
            break
        before = after
    roots = tree.select(F.col("v").alias("id")).distinct()
    return tree.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
