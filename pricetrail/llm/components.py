"""Connected components of a link table, by Spark joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shuffles_go

MAX_ROUNDS = 60
LINKS_A_TASK = 100_000


def unsettled(edges: DataFrame) -> bool:
    """Whether some node of links u, v points at two nodes, or is pointed at and points at another."""
    with shuffles_go(edges.sparkSession):
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """The least node each linked node reaches: columns ``node`` and ``root``, both long.

    Distributed union-find in rounds: every node points its larger neighbours at the
    least node it knows, then every node points its smaller neighbours there, until
    all links are stars. Links stay as many as there are nodes, so a round's data does
    not grow. A round's minima are checkpointed before they are joined back, so that
    both sides of the join are plain exchanges and a node with very many neighbours
    is split. What is checkpointed lies in as many parts as the number of links asks for, but in one for each core at
    least, as each part costs files in every exchange after it. Links from a node to itself and null ends are left out; nodes without
    another link do not come back.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = checkpointed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // LINKS_A_TASK))
    held = lambda rows: checkpointed(rows.coalesce(parts))
    edges = edges.coalesce(parts)
    for _ in range(MAX_ROUNDS):
        if not unsettled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = held(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = held(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = held(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = held(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
