"""The link queries over small tables."""

from datetime import datetime

import pytest

from loam.operators import linking
from loam.plans.linkage import QUERIES

NODE = "id string, path string, type string, title string, body string, origin string, importance float, access_count int, pin_triggers array<string>, embedding array<float>, valid_until timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"
LINK = "id string, from_id string, to_id string, rel_type string, link_origin string, confidence float, created_at timestamp_ntz, updated_at timestamp_ntz"


@pytest.fixture
def tables(spark, tmp_path):
    def write(nodes, links=()):
        full = [({"type": "feedback", "origin": "curated"} | n) for n in nodes]
        spark.createDataFrame([tuple(n.get(c.split()[0]) for c in NODE.split(", ")) for n in full], NODE).write.parquet(f"{tmp_path}/memory_nodes.parquet")
        spark.createDataFrame([(f"l{i}", a, b, "related", origin, c, None, None) for i, (a, b, origin, c) in enumerate(links)], LINK).write.parquet(f"{tmp_path}/memory_links.parquet")
        return str(tmp_path)

    return write


def test_candidates_of_all_generators(spark, tables):
    d = tables([{"id": x, "path": f"/feedback/{x}", "body": "see /feedback/e." if x == "f" else None} for x in "abcdefgh"], [("a", "c", "explicit", None), ("b", "c", "explicit", None), ("g", "h", "inferred", 0.2)])
    pairs = {("a", "b"), ("g", "h"), ("e", "f")}
    assert {(r.a[-1], r.b[-1]) for r in QUERIES["link_candidates"](spark, d).collect()} == pairs
    assert {(r.a[-1], r.b[-1]): r.confidence for r in QUERIES["link_confidence"](spark, d).collect()}["e", "f"] == 0.95
    assert {(r.a[-1], r.b[-1]): r.action for r in QUERIES["link_routing"](spark, d).collect()} == {("g", "h"): "rescore", ("e", "f"): "link"}


def test_similar_nodes_of_any_type(spark, tables):
    v = [1.0] * 384
    d = tables([{"id": "1", "path": "/notes/a", "type": "note", "title": "quartz lattice", "embedding": v}, {"id": "2", "path": "/user/b", "type": "user", "title": "quartz lattice", "embedding": v}])
    for name in ("all_pairs_cosine", "infer_links", "link_candidates", "duplicate_keep", "knn_self_join", "postings_join"):
        assert QUERIES[name](spark, d).count() == (2 if name in ("knn_self_join", "postings_join") else 1), name


@pytest.mark.parametrize("block", [200, 7])
def test_two_hops_over_a_hub(spark, block):
    n = 230
    edges = [("hub", f"n{i:03}") for i in range(n)] + [("n000", "x"), ("x", "n000")]
    got = linking.two_hop(spark.createDataFrame(edges, "from_path string, to_path string"), block).collect()
    want = {(f"n{i:03}", f"n{j:03}") for i in range(n) for j in range(i + 1, n)} | {("hub", "x")}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_neighbours_have_no_floor(spark, tables):
    d = tables([{"id": "1", "path": "/feedback/a", "embedding": [1.0] * 384}, {"id": "2", "path": "/feedback/b", "embedding": [-1.0] * 383 + [-0.5]}])
    assert {(r.a[-1], r.b[-1], r["rank"]) for r in QUERIES["knn_self_join"](spark, d).collect()} == {("a", "b", 1), ("b", "a", 1)}
    assert QUERIES["shared_rank"](spark, d).count() == 2 and QUERIES["csls_hub"](spark, d).first().hub < -0.9
    assert QUERIES["link_features"](spark, d).first().mutual_rank == 1.0


def test_proposals_of_all_live_nodes(spark, tables):
    old, day = datetime(2020, 1, 1), datetime(2026, 11, 5, 12)
    d = tables([
        {"id": "1", "path": "/notes/expired", "type": "note", "valid_until": old, "created_at": old, "updated_at": day},
        {"id": "2", "path": "/user/stale", "type": "user", "importance": 0.1, "created_at": old, "updated_at": datetime(2020, 1, 5)},
        {"id": "3", "path": "/references/dated", "type": "reference", "body": "Seen yesterday.", "created_at": day, "updated_at": day},
        {"id": "4", "path": "/notes/gone", "type": "note", "valid_until": old, "deleted_at": day, "updated_at": day},
        {"id": "5", "path": "/notes", "type": "category", "importance": 0.1, "created_at": old, "updated_at": datetime(2020, 1, 5)},
    ])
    assert {(r.kind, r.paths) for r in QUERIES["consolidation_queue"](spark, d).collect()} == {("expired", "/notes/expired"), ("stale", "/user/stale"), ("relative_dates", "/references/dated")}


def test_distances_to_six_hops(spark, tables):
    ends = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "h"), ("a", "x"), ("a", "y")]
    d = tables([{"id": x, "path": f"/feedback/{x}"} for x in "abcdefghxy"], [(a, b, "explicit", None) for a, b in ends])
    assert {r.node[-1]: r.hops for r in QUERIES["bfs_distance"](spark, d).collect()} == {x: i for i, x in enumerate("abcdefg")} | {"x": 1, "y": 1}
