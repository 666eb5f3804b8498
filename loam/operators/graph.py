"""The link graph: degrees, components, shortest paths, similar pairs, reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.components import connected_components
from loam.operators.retrieval import directed
from loam.session import materialize


def links_of(links: DataFrame) -> DataFrame:
    """Links with their ids in lower case, each id once (rows delivered twice count once)."""
    return links.withColumn("from_id", F.lower("from_id")).withColumn("to_id", F.lower("to_id")).dropDuplicates(["id"])


def subgraph(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The links both of whose ends are among the nodes."""
    ids = nodes.select("id")
    return links.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def named_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(from_path, to_path, rel_type, link_origin, confidence)."""
    a = nodes.select(F.col("id").alias("from_id"), F.col("path").alias("from_path"))
    b = nodes.select(F.col("id").alias("to_id"), F.col("path").alias("to_path"))
    return links.join(a, "from_id").join(b, "to_id").select("from_path", "to_path", "rel_type", "link_origin", "confidence")


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(path, degree) of every node; a loop counts twice, a node without links 0."""
    ends = links.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id", "path").join(ends, "id", "left").select("path", F.coalesce("degree", F.lit(0)).alias("degree"))


def orphan_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(path) of nodes that no link touches."""
    touched = links.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return nodes.join(touched, "id", "left_anti").select("path")


def node_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(path, component: least path in it, size) of every node, those alone too."""
    named = named_links(nodes, links)
    found = connected_components(named.select(F.col("from_path").alias("src"), F.col("to_path").alias("dst")))
    rows = nodes.select("path").join(found.select(F.col("node").alias("path"), "component"), "path", "left").withColumn("component", F.coalesce("component", "path"))
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return rows.join(sizes, "component").select("path", "component", "size")


def distances(edges: DataFrame, start: str, most: int = 6) -> DataFrame:
    """(node, hops, previous) of all nodes within `most` hops of the start, links taken in either direction; of several previous nodes the least.

    edges: (src, dst). Each round joins only the frontier; it ends when that is empty."""
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src != dst").distinct())
    spark = edges.sparkSession
    seen = frontier = spark.createDataFrame([(start, 0, None)], "node string, hops int, previous string")
    for hop in range(1, most + 1):
        step = frontier.select(F.col("node").alias("src")).join(both, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("previous"))
        frontier = materialize(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops"), "previous"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 6) -> DataFrame:
    """(hop, node, previous, rel_type, stored) along one shortest path, with its ends; empty if there is none within `most` hops.

    edges: (src, dst) and perhaps rel_type. stored: `out` where the link that was taken is stored from previous to node, `in` where it
    is stored the other way; of several links one that is stored `out`, then the first by type."""
    reach = materialize(distances(edges, start, most))
    now = reach.filter(F.col("node") == end)
    out = now
    for _ in range(most):
        now = reach.join(now.select(F.col("previous").alias("node")), "node", "left_semi")
        out = out.unionByName(now)
    kind = F.col("rel_type") if "rel_type" in edges.columns else F.lit(None).cast("string")
    stored = edges.select("src", "dst", kind.alias("rel_type"))
    both = stored.select(F.col("src").alias("previous"), F.col("dst").alias("node"), F.struct(F.lit(0).alias("o"), "rel_type").alias("l")).unionByName(stored.select(F.col("dst").alias("previous"), F.col("src").alias("node"), F.struct(F.lit(1).alias("o"), "rel_type").alias("l")))
    path = out.select(F.col("hops").alias("hop"), "node", "previous").distinct()
    used = both.join(path.select("previous", "node"), ["previous", "node"], "left_semi").groupBy("previous", "node").agg(F.min("l").alias("l"))
    return path.join(used, ["previous", "node"], "left").select("hop", "node", "previous", F.col("l.rel_type").alias("rel_type"), F.when(F.col("l.o") == 0, "out").when(F.col("l.o") == 1, "in").alias("stored"))


def _block_pairs(least: float):
    """A function over two blocks of rows (blk, path, v): the similar pairs between them, or within one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("blk", "ascending"), ("path", "ascending")])
        block, paths = table.column("blk").to_numpy(), table.column("path")
        v = np.asarray(table.column("v").combine_chunks().flatten(), np.float64).reshape(len(block), -1)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        n = int(np.searchsorted(block, block[0], "right"))
        alone = n == len(block)
        other = v if alone else v[n:]
        i, j, sim = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for at in range(0, n, 512):
            s = v[at : min(at + 512, n)] @ other.T
            x, y = np.nonzero(s >= least - 1e-9)
            ok = (at + x < y) if alone else np.ones(len(x), bool)
            i.append(at + x[ok])
            j.append(y[ok] + (0 if alone else n))
            sim.append(s[x[ok], y[ok]])
        i, j = np.concatenate(i), np.concatenate(j)
        return pa.table({"pa": paths.take(pa.array(i)), "pb": paths.take(pa.array(j)), "sim": np.concatenate(sim)})

    return run


def similar_pairs(nodes: DataFrame, least: float, dims: int, block: int = 2048) -> DataFrame:
    """(path_a, path_b, sim): all pairs of a scope with a cosine of at least `least`, path_a < path_b. Vectors that aren't usable have none.

    Exact, so every two rows are compared, block against block in matrix products; each pair of blocks is a task of
    bounded size and only similar pairs leave it. neighbours.similar_pairs is the form that scales."""
    from loam.functions.vector import usable_vector

    rows = materialize(nodes.filter(usable_vector(F.col("embedding"), dims)).select("path", F.col("embedding").alias("v")))  # not widened: each row travels to every block
    blocks = max(1, -(-rows.count() // block))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("path"), F.lit(blocks)).cast("int"))
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    each = each.select(F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), "blk", "path", "v")
    found = each.groupBy("p", "q").applyInArrow(_block_pairs(least), "pa string, pb string, sim double")
    return found.select(F.least("pa", "pb").alias("path_a"), F.greatest("pa", "pb").alias("path_b"), F.round("sim", 9).alias("sim")).filter(F.col("sim") >= least)


def unlinked(pairs: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of paths that no link joins in either direction."""
    named = named_links(nodes, links).select(F.least("from_path", "to_path").alias("path_a"), F.greatest("from_path", "to_path").alias("path_b")).distinct()
    return pairs.join(named, ["path_a", "path_b"], "left_anti")


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(path, below): number of nodes below every ancestor that is itself a node."""
    from loam.functions.paths import ancestors

    up = nodes.select(F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("below"))
    return nodes.select("path").join(up, "path")


def nearest_ancestor(nodes: DataFrame) -> DataFrame:
    """(path, ancestor): the nearest ancestor that exists, null at the top."""
    from loam.functions.paths import ancestors

    up = nodes.select("path", F.posexplode_outer(ancestors(F.col("path"))).alias("i", "ancestor"))
    there = up.join(nodes.select(F.col("path").alias("ancestor"), F.lit(True).alias("ok")), "ancestor", "left")
    return there.groupBy("path").agg(F.max(F.when(F.col("ok"), F.struct("i", "ancestor")))["ancestor"].alias("ancestor"))


def layout_groups(nodes: DataFrame) -> DataFrame:
    """(grp, n, position): branches by size."""
    from loam.functions.paths import branch

    sizes = nodes.groupBy(branch(F.col("path")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "grp")).cast("long"))


def graph_payload(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, a, b, n): the nodes with their degree and the links between them, in one table."""
    sub = subgraph(nodes, links)
    n = degrees(nodes, sub).select(F.lit("node").alias("kind"), F.col("path").alias("a"), F.lit(None).cast("string").alias("b"), F.col("degree").alias("n"))
    e = named_links(nodes, sub).groupBy("from_path", "to_path").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), F.col("from_path").alias("a"), F.col("to_path").alias("b"), "n")
    return n.unionByName(e)


def explain_node(nodes: DataFrame, links: DataFrame, path: str) -> DataFrame:
    """(direction, rel_type, neighbour) of one node."""
    one = nodes.filter(F.col("path") == path).select("id")
    other = nodes.select(F.col("id").alias("other"), F.col("path").alias("neighbour"))
    return directed(links).join(F.broadcast(one), "id", "left_semi").join(other, "other").select("direction", "rel_type", "neighbour")


