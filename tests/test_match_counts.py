from loam.operators import reads, retrieval

from tests.test_inverted import most_rows

COLUMNS = "id string, path string, title string, body string, embedding array<float>, importance double, updated_at timestamp_ntz"


def _nodes(spark, rows):
    return spark.createDataFrame([(f"i{i}", p, t, b, None, None, None) for i, (p, t, b) in enumerate(rows)], COLUMNS)


def test_hidden_nodes_are_counted_without_all_pairs(spark):
    """300 queries ask for what all of 150 nodes have: a search counts their 45,000 pairs, and no step holds them."""
    rows = [(f"/n{i:03}", None if i % 3 else "lattice", f"quartz {'lattice quartz' if i % 2 else 'lattice'}") for i in range(150)]
    queries = [(f"q{i}", "Quartz lattice" if i % 2 else "lattice QUARTZ", None) for i in range(300)] + [("part", "attice quar", None), ("none", None, None), ("short", "of", None), ("no", "nowhere", None)]
    n, q = _nodes(spark, rows), spark.createDataFrame(queries, "query string, text string, vector array<float>")
    links = spark.createDataFrame([], "id string, from_id string, to_id string, rel_type string")
    got, most = most_rows(reads.search(n.limit(1), n, links, q, "2026-01-01 00:00:00").filter("kind = 'hidden'"))
    part = sum("attice quar" in f"{t or ''}\n{b}" for _, t, b in rows)
    assert {r.query: r.score for r in got} == {f"q{i}": 150 for i in range(300)} | {"part": part} and 0 < part < 150 and len(got) == 301
    assert most < 10_000


def test_a_path_or_query_that_occurs_twice_counts_once(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROUND", 2)
    n = _nodes(spark, [("/a", "quartz", "river"), ("/a", "quartz river", None), ("/b", None, "river of quartz"), ("/c", "a quartz river", "of"), ("/d", "aquartz", None)])
    q = spark.createDataFrame([("x", "quartz river"), ("y", "quartz"), ("y", "river"), ("z", "Quartz"), ("w", "river of"), ("v", ""), ("u", "quartz r"), ("t", "aquartz")], "query string, text string")
    got = retrieval.match_counts(n, q).collect()
    assert {r.query: r.n for r in got} == {"x": 3, "y": 4, "z": 4, "w": 3, "u": 3, "t": 1} and len(got) == 6
