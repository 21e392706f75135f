"""Connected components over a table of links, without gathering it anywhere.

Large-star and small-star rounds: a round joins every neighbour to the smallest one, so
paths halve; each round is a written table, and the table before it is removed. The smallest
neighbours are written before they are joined, so that a node with very many links can be
split between tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Written, written

#: A guard against a defect, far above log2 of any number of nodes.
MOST_ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = written(edges.groupBy("hi").agg(F.min("lo").alias("m")), "least")
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node that has a link; the component is its smallest node."""
    edges = links.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")).where("hi <> lo").distinct()
    now = Written(edges, "links", narrow=True)
    mark = _mark(now.df)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        large = Written(_large_star(now.df), "large-star", narrow=True)
        after = Written(_small_star(large.df), "links", narrow=True)
        now.drop()
        large.drop()
        now, before, mark = after, mark, _mark(after.df)
        if mark == before:
            break
    else:
        raise RuntimeError("the links did not settle")
    stars = now.df
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
