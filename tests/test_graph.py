import random

from loam.operators.components import connected_components
from pyspark.sql import functions as F

from loam.operators.graph import degrees, distances, shortest_path, similar_pairs


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(200)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(80)] + [("hub", f"h{i}") for i in range(50)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(None, "x")], "src string, dst string")).collect()}
    assert found == brute(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_distances_and_path(spark):
    edges = [("a", "b"), ("c", "b"), ("c", "d"), ("d", "e"), ("x", "y"), ("a", "a")]
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {r.node: r.hops for r in distances(df, "a", 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert [r.node for r in shortest_path(df, "a", "d").orderBy("hop").collect()] == ["a", "b", "c", "d"]
    assert shortest_path(df, "a", "y").count() == 0
    kinds = df.withColumn("rel_type", F.lit("related")).unionByName(spark.createDataFrame([("n", "m", "supports"), ("n", "o", "requires")], "src string, dst string, rel_type string"))
    assert [(r.previous, r.node, r.rel_type, r.stored) for r in shortest_path(kinds, "m", "o").orderBy("hop").collect()] == [(None, "m", None, None), ("m", "n", "supports", "in"), ("n", "o", "requires", "out")]


def test_a_loop_counts_twice(spark):
    nodes = spark.createDataFrame([("1", "/a"), ("2", "/b"), ("3", "/c")], "id string, path string")
    links = spark.createDataFrame([("1", "1"), ("1", "2")], "from_id string, to_id string")
    assert {r.path: r.degree for r in degrees(nodes, links).collect()} == {"/a": 3, "/b": 1, "/c": 0}


def test_similar_pairs_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.standard_normal((8, 16))
    v = np.repeat(base, 6, 0) + 0.35 * rng.standard_normal((48, 16))
    rows = [(f"/{i:02}", [float(x) for x in y]) for i, y in enumerate(v)] + [("/null", None), ("/zero", [0.0] * 16), ("/short", [1.0])]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    for least in (0.9, 0.6, 0.1):
        want = {(f"/{i:02}", f"/{j:02}") for i in range(48) for j in range(i + 1, 48) if s[i, j] >= least}
        for block in (2048, 20):
            got = similar_pairs(spark.createDataFrame(rows, "path string, embedding array<double>"), least, 16, block).collect()
            assert {(r.path_a, r.path_b) for r in got} == want and len(got) == len(want)
    assert similar_pairs(spark.createDataFrame(rows[-3:], "path string, embedding array<double>"), 0.1, 16).count() == 0
