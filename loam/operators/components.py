"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.session import materialize

#: Rounds after which something must be wrong; the steps need O(log n) of them.
ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's greater (large star) or not greater (small star) neighbours to the least neighbour."""
    if small:
        pairs = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    else:
        pairs = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = pairs.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    joined = pairs.join(least, "src")
    if small:
        out = joined.select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(joined.select("src", F.col("least").alias("dst")))
    else:
        out = joined.filter("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return out.filter("src != dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (src, dst); component is its least node. Edges with a null end are ignored;
    loops give their node a component. The list of edges shrinks to stars; each round is written to the shared folder."""
    edges = edges.select("src", "dst").dropna()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    now = materialize(edges.filter("src != dst").distinct())
    last = None
    for _ in range(ROUNDS):
        now = materialize(_star(_star(now, small=False), small=True))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle within {ROUNDS} rounds")
    return nodes.join(now.select(F.col("src").alias("node"), F.col("dst").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
