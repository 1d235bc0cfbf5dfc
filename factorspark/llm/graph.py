"""Connected components of an edge table by alternating large and small stars.

Each round is two joins with a table of smallest neighbours, written to the shared folder, so that lineage stays short and a
lost executor costs a round at most. Only two numbers of each round reach the driver. A hub's rows meet one row of the table
of smallest neighbours, so adaptive execution can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import discard, written


def _starred(pairs: DataFrame) -> DataFrame:
    """(u, v): the smallest of u and all its v, as table (u, m)."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_starred(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _starred(down)
    moved = down.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge. Null ends and loops are left out.

    Edges are of any ordered type. Raises if `most_rounds` do not suffice; a path of n nodes takes about log2(n) rounds.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v AND v IS NOT NULL").distinct(), "edges"
    )
    before = None
    for _ in range(most_rounds):
        earlier, now = now, written(small_star(large_star(now)), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(earlier)
        if tuple(state) == before:
            own = now.select(F.col("v").alias("u"), "v").distinct()
            return now.union(own).select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = tuple(state)
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
