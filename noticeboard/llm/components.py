"""Connected components of links between ids, as DataFrame steps that end in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from noticeboard.llm.common import discard, stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (its least id) of all ids in links (a, b), by large-star and small-star steps.

    Each step is a minimum by node (added up before the shuffle) and a join with the links of the node, so a node
    with very many links is split by adaptive execution; a star takes two rounds, a path of n about log n. The links
    are written to the shared folder after each round; their number and a checksum come along with the writing, and
    nothing else reaches the driver.
    """
    edges, before = _written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    for _ in range(rounds):
        old = edges
        edges, now = _written(_small(_large(edges)))
        discard(old)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table, with their number and checksum."""
    seen = Observation()
    sums = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
    out = stored(edges.observe(seen, *sums), "links")
    return out, (seen.get["n"], seen.get["sum"])


def _large(edges: DataFrame) -> DataFrame:
    """Of each node, its greater neighbours go to the least of its neighbours and itself (links may come twice)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Of each node, its lesser neighbours and itself go to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
