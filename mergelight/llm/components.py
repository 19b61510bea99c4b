"""Connected components of a link table, by hooking to smaller labels and jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelight.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that has a link; component is the least id reachable.

    Each round replaces links by links to the least neighbour: first of larger ids, then of
    smaller ones, so that chains halve and stars stay stars.  Links never grow in number, and
    rounds grow with the logarithm of the longest chain.  Each round is a checkpoint.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = cut_lineage(links.select(high.alias("u"), low.alias("v")).where("u <> v").distinct())
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # larger neighbours hang on the least neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # smaller neighbours and the node itself hang on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = cut_lineage(small.where("u <> v").distinct())
        edges, state, last = after, _state(after), state
        if state == last:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    """Number of links and a sum of their hashes: equal sets of links have equal states."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
