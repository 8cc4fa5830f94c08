"""Connected components by alternating large-star and small-star steps.

Each step sends every neighbour of a node to the smallest node it knows, which
halves paths, so a few rounds settle chains as well as stars.  A round is two
aggregations (combined before the shuffle, so a hub costs one row per task)
and two joins on the node that adaptive execution may split when a hub holds
many edges.  Every round is written to the shared folder.

Each job leaves broadcast buffers of some megabytes on the driver, so a round
reads its edges as seldom as it can, the rounds end as soon as all edges are
stars, and what a round leaves is released before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argusline.llm.common import Stages


def _both_ways(edges: DataFrame) -> DataFrame:
    """u, v, down: every edge from both of its ends, in one read; ``down`` is 1 from the larger."""
    ways = F.array(F.struct("u", "v", F.lit(1).alias("down")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("down")))
    return edges.select(F.explode(ways).alias("e")).select("e.u", "e.v", "e.down")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node, which has none, or is such a node."""
    seen = _both_ways(edges).groupBy("u").agg(F.sum("down").alias("down"), F.count("*").alias("n"))
    return not seen.agg(F.max(F.expr("down > 0 AND n > 1"))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges).select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u")
        .where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    sent = edges.join(least, "u")
    return (
        sent.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(edges: DataFrame, a: str, b: str, stages: Stages, max_rounds: int = 60) -> DataFrame:
    """Nodes of ``edges`` with the smallest node they can reach.

    Null ends and self links are ignored; an empty table gives an empty table.
    Returns ``node, root``; every node that has an edge appears once.
    """
    a, b = F.col(a), F.col(b)
    state = stages.write(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        # No edges are stars, too.
        if _are_stars(state):
            break
        wide = _large_star(state)
        step = stages.write(_small_star(wide), "edges")
        stages.drop(state)
        stages.release()
        state = step
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
