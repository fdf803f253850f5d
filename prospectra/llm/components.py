"""Connected components of links between numbered nodes, as joins and groupings only.

Links are rewritten by turns: every node hands its larger neighbours, then its smaller ones, to the
smallest node that it knows (the large-star and small-star steps), until links lead straight to
the smallest node of each component. Nothing is gathered per component: a node's neighbours are
only ever reduced to a minimum and joined with it, so a hub is a skewed key of a plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.llm import scratch


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link in `links` (columns a, b); root is the component's smallest node.

    Links may be repeated, in either direction, or lead from a node to itself.
    """
    now = scratch.stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = None
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_rounds):
        last, now = now, scratch.stored(_small_star(_large_star(now)))
        scratch.drop(last)
        # Equal sums of a hash over all links mean that nothing changed.
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
