import numpy as np

from loam.llm.knn import knn, neighbour_pairs
from loam.operators import vector_lists as vl


def vectors(n, dims, clusters, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((clusters, dims))
    return (c[rng.integers(0, clusters, n)] + 0.6 * rng.standard_normal((n, dims))).astype(np.float32)


def frame(spark, v, extra=()):
    rows = [(f"v{i:05}", [float(x) for x in y], 1) for i, y in enumerate(v)] + list(extra)
    return spark.createDataFrame(rows, "id string, vec array<float>, part int")


def brute(v, k):
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(f"v{i:05}", f"v{j:05}") for i in range(len(v)) for j in np.argsort(-s[i], kind="stable")[:k]}


def test_recall_over_several_parts(spark):
    v = vectors(3000, 96, 40)
    got = {(r.id, r.neighbour) for r in knn(frame(spark, v), "id", "vec", 96, k=5, part=400).collect()}
    want = brute(v, 5)
    assert len(got) == 15000 and len(got & want) >= 0.95 * len(want)


def test_unusable_copies_and_ties(spark):
    v = np.array([[1, 0, 0, 0], [0.9, 0.1, 0, 0], [0, 1, 0, 0], [0, 0.9, 0.1, 0]], np.float32)
    bad = [("n", None, 1), ("e", [], 1), ("z", [0.0] * 4, 1), ("z2", [0.0] * 4, 1), ("nan", [float("nan"), 1.0, 0.0, 0.0], 1), ("inf", [float("inf"), 1.0, 0.0, 0.0], 1), ("cut", [1.0], 1), ("hole", [1.0, None, 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0, 0.0], 1)]
    copies = [(f"c{i}", [0.0, 0.0, 0.0, 2.0], 1) for i in range(9)] + [("c0", [0.0, 0.0, 0.0, 2.0], 1), ("big", [0.0, 0.0, 0.0, 8.0], 1)]
    df = frame(spark, v, bad + copies)
    rows = knn(df, "id", "vec", 4, k=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append((r.neighbour, round(r.similarity, 6)))
    assert set(by) == {"v00000", "v00001", "v00002", "v00003", "big", *(f"c{i}" for i in range(9))}
    assert all(len(x) == 2 for x in by.values()) and by["v00000"][0][0] == "v00001"
    assert all(s == 1.0 and n != i for i in by if i[0] in "cb" for n, s in by[i])
    tied = knn(df, "id", "vec", 4, k=2, ties=1e-6).filter("id = 'c3'").collect()
    assert {r.neighbour for r in tied} == {"big", *(f"c{i}" for i in range(9) if i != 3)}
    pairs = neighbour_pairs(knn(df, "id", "vec", 4, k=2)).collect()
    assert all(r.id_a < r.id_b for r in pairs) and len(pairs) == len(set(map(tuple, pairs)))


def test_empty_and_lonely(spark):
    df = frame(spark, np.ones((1, 4), np.float32))
    assert knn(df, "id", "vec", 4).count() == 0 and knn(df.limit(0), "id", "vec", 4).count() == 0
    assert knn(df, "id", "vec", 5).count() == 0


def test_recall_over_two_levels(spark):
    """With a first level of five lists, each is split; recall holds."""
    v = vectors(4000, 64, 60, seed=3)
    got = {(r.id, r.neighbour) for r in knn(frame(spark, v), "id", "vec", 64, k=5, part=200, lists=5).collect()}
    want = brute(v, 5)
    assert len(got) == 20000 and len(got & want) >= 0.9 * len(want)


def test_a_third_of_the_rows_alike(spark):
    """Many equal vectors and many nearly equal ones: each class of equal ones is one row of the search, and nothing is lost among the others."""
    v = vectors(1500, 32, 20, seed=5)
    v[:500] = v[0]
    v[500:800] = v[500] + 1e-3 * np.random.default_rng(1).standard_normal((300, 32)).astype(np.float32)
    rows = knn(frame(spark, v), "id", "vec", 32, k=5, part=100).collect()
    got = {(r.id, r.neighbour) for r in rows}
    want = {p for p in brute(v, 5) if int(p[0][1:]) >= 500}
    assert len(got) == 7500 and len(got & want) >= 0.9 * len(want)
    assert all(r.similarity > 1 - 1e-9 for r in rows if int(r.id[1:]) < 500)


def test_small_groups_that_the_sample_misses(spark, monkeypatch):
    """Most groups of alike vectors have none in the sample that the centroids are fitted on; their members still meet."""
    for name in ("SAMPLE", "MOST_SAMPLE"):
        monkeypatch.setattr(vl, name, 200, raising=False)
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((400, 96))
    v = (np.repeat(centres, 10, axis=0) + 0.4 * rng.standard_normal((4000, 96))).astype(np.float32)
    got = {(r.id, r.neighbour) for r in knn(frame(spark, v), "id", "vec", 96, k=5, part=100).collect()}
    want = brute(v, 5)
    assert len(got) == 20000 and len(got & want) >= 0.97 * len(want)
