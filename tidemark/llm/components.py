"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut_marked

#: Edge lists of up to so many rows are worked on in one partition, as a shuffle would cost more than the work.
ONE_PARTITION = 300_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One round: every node's neighbours (large: the larger, else the smaller ones) are tied to its least neighbour."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = both.coalesce(1) if few else both
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(joined.select("a", F.col("m").alias("b")))
    out = out.coalesce(1) if few else out
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): for every node of an edge, the least node that it reaches.

    edges has columns a and b of one type; loops, repeats and either direction are
    fine; nulls are left out; no edges give no rows.  The number of rounds grows
    with the logarithm of the longest path, and each round is cut from its lineage.
    """
    tidy = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = cut_marked(tidy, ["a", "b"], "edges")
    while mark[0]:
        before, few = mark, mark[0] <= ONE_PARTITION
        now, mark = cut_marked(_star(_star(now, True, few), False, few), ["a", "b"], "edges")
        if mark == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return stars.unionAll(stars.select(F.col("comp").alias("node"), "comp").distinct())
