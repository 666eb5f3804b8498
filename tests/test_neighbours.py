import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import neighbours
from loam.operators import vector_lists as vl


@pytest.mark.parametrize(("rows", "cut", "exact"), [(1024, 4096, False), (20, 7, True)])
def test_ranks_match_brute_force(spark, monkeypatch, rows, cut, exact):
    """Neighbours of negative similarity count too, equal ones go by path."""
    monkeypatch.setattr(neighbours, "ROWS", rows)
    monkeypatch.setattr(neighbours, "CUT", cut)
    v = np.random.default_rng(2).standard_normal((50, 4)).astype(np.float32).astype(np.float64)
    v[7] = v[31] = v[9]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    name = [f"/{i * 7 % 50:02}" for i in range(50)]
    want = {}
    for i in range(50):
        order = sorted((j for j in range(50) if j != i), key=lambda j: (-s[i, j], name[j]))
        want |= {(name[i], name[j]): (s[i, j], r + 1) for r, j in enumerate(order)}
    table = [(name[i], [float(x) for x in v[i]]) for i in range(50)] + [("/null", None), ("/zero", [0.0] * 4)]
    nodes = spark.createDataFrame(table, "path string, embedding array<double>")
    got = neighbours.nearest(nodes, 30, 4, exact).collect()
    assert {(r.a, r.b): r["rank"] for r in got} == {k: r for k, (_, r) in want.items() if r <= 30} and len(got) == 1500
    pairs = spark.createDataFrame([(a, b) for a, b in want if a < b] + [("/00", "/null"), ("/zero", "/01")], "a string, b string")
    vectors = neighbours.packed_vectors(nodes, 4)
    got = neighbours.ranks(vectors, neighbours.similarities(vectors, pairs, 4), 4).collect()
    assert {(r.a, r.b): (r.sim, r["rank"]) for r in got} == {k: (pytest.approx(x), r) for k, (x, r) in want.items()} and len(got) == len(want)
    assert neighbours.nearest(nodes.filter("path = '/null'"), 3, 4).count() == 0


def clustered(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 40), dims))
    return (centres[rng.integers(0, len(centres), n)] + 0.4 * rng.standard_normal((n, dims))).astype(np.float32)


def frame(spark, v):
    return spark.createDataFrame([(f"/{i:05}", [float(x) for x in row]) for i, row in enumerate(v)], "path string, embedding array<float>")


def test_lists_of_two_levels_keep_recall_and_bound_the_copies(spark):
    """With the first level forced small, lists are split; neighbours are found, and a vector's copies stay bounded as n grows."""
    for n in (1200, 4800):
        v = clustered(n, 32)
        rows = frame(spark, v).select(F.col("path").alias("id"), F.col("embedding").alias("vec"))
        tree = vl.fit_lists(rows, n, 32, lists=4, part=100)
        assert len(tree.files) >= 3
        sent = vl.routed(rows.select("id", "vec", F.lit(True).alias("asks"), F.lit(True).alias("answers")), tree)
        copies = sent.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("home") >= 0).alias("homes")).agg(F.max("n").alias("n"), F.min("homes").alias("low"), F.max("homes").alias("high"), F.count("*").alias("ids")).first()
        assert copies.low == copies.high == 1 and copies.ids == n and copies.n <= vl.PROBES**2
        assert sent.filter("home >= 0").groupBy("part").count().agg(F.max("count")).first()[0] <= 800
        got = vl.among_all(rows, 32, 5, 0.0, lambda d, k, t: vl.search_part(d, k), lists=4, part=100).collect()
        u = vl.unit(v, np.float64)
        s = u @ u.T
        np.fill_diagonal(s, -2)
        want = {(i, int(j)) for i, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in row}
        found = {(int(r.id[1:]), int(r.neighbour[1:])) for r in got}
        assert len(got) == 5 * n and len(found & want) >= 0.9 * len(want)


def test_copies_of_a_vector_are_one_row_of_the_search(spark):
    v = clustered(300, 16)
    v[:120] = v[0]
    nodes = frame(spark, v)
    got = {(r.path_a, r.path_b): r.sim for r in neighbours.similar_pairs(nodes, 0.7, 16).collect()}
    want = {(r.path_a, r.path_b): r.sim for r in neighbours.similar_pairs(nodes, 0.7, 16, exact=True).collect()}
    assert set(got) == set(want) and all(abs(got[k] - x) < 1e-6 for k, x in want.items())
    near = neighbours.nearest(nodes, 6, 16).filter("a = '/00005'").orderBy("rank").collect()
    assert [(r.b, r.sim) for r in near] == [(f"/{i:05}", 1.0) for i in (0, 1, 2, 3, 4, 6)]


def test_searches_of_queries(spark):
    v = clustered(900, 16)
    rows = frame(spark, v).select(F.col("path").alias("id"), F.col("embedding").alias("vec"))
    queries = spark.createDataFrame([("/00001", [float(x) for x in v[7]]), ("zero", [0.0] * 16), ("short", [1.0])], "id string, vec array<float>").filter(F.size("vec") == 16)
    got = vl.among_queries(rows, queries, 16, 3).collect()
    assert len(got) == 3 and {r.id for r in got} == {"/00001"} and max(got, key=lambda r: r.similarity).neighbour == "/00007"


@pytest.mark.parametrize("target", [10, 200, 10000])
def test_packing_holds_every_list_once(target):
    c, n = vl.fit_centroids(vl.unit(clustered(500, 16)), 40)
    weights = n.astype(float)
    of, parts = vl.pack_lists(c, weights, target)
    assert set(of) == set(range(parts))
    load = np.bincount(of, weights)
    assert all(load[p] <= target or (of == p).sum() == 1 for p in range(parts))
    assert vl.pack_lists(c[:0], weights[:0], target)[1] == 0
