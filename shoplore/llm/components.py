"""Connected components of a large graph by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplore.llm.common import Scratch, removed


def connected_components(edges: DataFrame, left: str = "left", right: str = "right",
                         most_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """``(vertex, component)`` for every vertex of an edge; the component is its smallest vertex.

    Alternates two steps: every vertex hands its smallest neighbour to its larger neighbours, then to
    its smaller ones. The number of edges never grows, and about log(vertices) squared rounds suffice
    in the worst case, a handful as a rule. Each step is one aggregate (merged before the shuffle)
    and one join, whose hot vertices can be split at run time; rounds are written to folders of the shared
    checkpoint folder, so that the lineage stays short, and a round's folder goes when the next one is there.
    The last one stays, or goes with ``scratch``. Loops, repeated edges and edges with a null are allowed and say nothing new.
    """
    a, b = F.col(f"`{left}`"), F.col(f"`{right}`")
    scratch = scratch or Scratch(edges.sparkSession)
    links = scratch.keep(edges.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent"))
                         .filter(a.isNotNull() & b.isNotNull())
                         .filter("child <> parent").distinct(), "links")
    begun = mark = _mark(links)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        links = scratch.keep(_small_star(_large_star(links)), "links")
        removed(scratch.spark, scratch.paths.pop(-2))
        before, mark = mark, _mark(links)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if not begun[0]:
        return links.select(F.col("child").alias("vertex"), F.col("parent").alias("component"))
    roots = links.select(F.col("parent").alias("vertex"), F.col("parent").alias("component")).distinct()
    return links.select(F.col("child").alias("vertex"), F.col("parent").alias("component")).unionByName(roots)


def _mark(links: DataFrame) -> tuple:
    """Number of edges and a digest that does not depend on their order."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("child", "parent")),
                           F.sum(F.xxhash64("parent", "child").cast("decimal(20,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a vertex are linked to the smallest vertex around it."""
    both = links.select(F.col("child").alias("v"), F.col("parent").alias("w")).unionByName(
        links.select(F.col("parent").alias("v"), F.col("child").alias("w")))
    least = both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
    return (both.filter("w > v").join(least, "v")
            .select(F.col("w").alias("child"), F.col("m").alias("parent")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of a vertex, and itself, are linked to the smallest of them."""
    least = links.groupBy("child").agg(F.min("parent").alias("m"))
    moved = (links.join(least, "child")
             .select(F.col("parent").alias("child"), F.col("m").alias("parent")))
    return (moved.unionByName(least.select("child", F.col("m").alias("parent")))
            .filter("child <> parent").distinct())
