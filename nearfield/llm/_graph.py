"""Connected components over links kept in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed


#: Nodes that hold more than one in HOT of all edges take their minimum by broadcast; there are fewer than HOT of them.
HOT = 500


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with m, the least v of their u. The edges of a hub stay where they are."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(least.where(F.col("n") > F.lit(total // HOT)).select(F.col("u").alias("_u"), F.col("m").alias("_m")))
    marked = edges.join(hot, F.col("u") == F.col("_u"), "left")
    cold = marked.where("_m is null").select("u", "v").join(least.where(F.col("n") <= F.lit(total // HOT)).select("u", "m"), "u")
    return marked.where("_m is not null").select("u", "v", F.col("_m").alias("m")).union(cold.select("u", "v", "m"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every end of an edge (u, v); component is the least node reachable.

    Large-star and small-star steps in turn: both take the least neighbour by a
    combinable minimum, so a hub costs no collected group, and all links stay in
    tables under the checkpoint folder. The least node of a component links to all
    its nodes in the end.
    """
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large, state[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = checkpointed(small)
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
