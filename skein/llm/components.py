"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is two joins-with-aggregate over the edges, so nothing is gathered on one machine; the hub of a star takes
part in partial aggregates and in a join whose skewed side AQE splits. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's smallest neighbour (or to the node itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of a link to another node.

    Null ends and links of a node to itself don't count; without links the result is empty.
    """
    kind = links.schema[a].dataType
    edges = (
        links.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
        .select(F.greatest(a, b).cast(kind).alias("u"), F.least(a, b).cast(kind).alias("v"))
        .distinct()
    )
    edges = materialize(edges, "edges")
    before = None
    for _ in range(max_rounds):
        if before is None and not edges.head(1):
            break
        step = materialize(_small_star(_large_star(edges)), "edges")
        release(edges)
        edges = step
        # A star forest is a fixed point; the sum tells apart tables of as many edges.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
