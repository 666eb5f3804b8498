import math
import random

import pytest

from loam.functions import text as tx
from loam.operators import linking, retrieval


def most_rows(df):
    """The rows of df, and the most rows that any step of its plan gave."""
    def walk(plan):
        while (kind := plan.getClass().getSimpleName()) == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            plan = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan()
        rows = plan.metrics().get("numOutputRows")
        yield rows.get().value() if rows.isDefined() else 0
        for i in range(plan.children().size()):
            yield from walk(plan.children().apply(i))

    return df.collect(), max(walk(df._jdf.queryExecution().executedPlan()))


def corpus(spark, n=150):
    """Nodes that all share two terms, queries that all ask for them."""
    rng = random.Random(4)
    word = lambda: f"word{rng.randrange(12)}"
    nodes = [(f"/n{i:03}", rng.choice([None, f"lattice {word()}"]), " ".join(["lattice", "quartz", *(word() for _ in range(rng.randrange(6)))])) for i in range(n)]
    queries = [(f"q{i}", f"Lattice quartz {word()} {word()}") for i in range(n)] + [("none", None), ("two", "lattice quartz"), ("absent", "lattice nowhere")]
    return nodes, queries, spark.createDataFrame(nodes, "path string, title string, body string"), spark.createDataFrame(queries, "query string, text string")


def small(monkeypatch):
    from loam.operators import inverted

    monkeypatch.setattr(inverted, "BLOCK", 20)
    monkeypatch.setattr(inverted, "CHUNK", 10)


def by_hand(nodes, queries):
    words = {p: [w for w in f"{t or ''} {b}".lower().split() if w not in tx.STOP_WORDS] for p, t, b in nodes}
    return words, {q: set((t or "").lower().split()) for q, t in queries}


def test_the_first_nodes_by_mass_come_without_all_pairs(spark, monkeypatch):
    """150 queries ask for terms that all of 150 nodes have: in parts of blocks and chunks, ties by path, no step holds their 23,000 pairs."""
    nodes, queries, n, q = corpus(spark)
    got, most = most_rows(retrieval.coverage(n, q, 2, 0.5, k=4))
    assert most < 5000
    small(monkeypatch)
    words, asked = by_hand(nodes, queries)
    idf = lambda t: math.log((len(nodes) + 1) / (sum(t in w for w in words.values()) + 0.5))
    weight = {t: idf(t) for a in asked.values() for t in a}
    title = {p: set((t or "").split()) for p, t, _ in nodes}
    want = {}
    for name, terms in asked.items():
        found = sorted((-round(sum(weight[t] for t in terms & set(w)), 9), p) for p, w in words.items() if terms & set(w))[:4]
        for m, p in found:
            if len(terms & set(words[p])) >= 2 and -m >= 0.5:
                whole = sum(weight[t] for t in terms)
                want[name, p] = min(1.0, -m / whole, 0.5 + sum(weight[t] for t in terms & title[p]) / whole)
    for rows in (got, retrieval.coverage(n, q, 2, 0.5, k=4).collect()):
        assert {(r.query, r.path): r.lex_conf for r in rows} == {x: pytest.approx(c, abs=1e-8) for x, c in want.items()} and len(rows) == len(want) > 100


def test_nodes_with_all_terms_come_without_all_pairs(spark, monkeypatch):
    nodes, queries, n, q = corpus(spark)
    got, most = most_rows(retrieval.lexical_arm(n, q, 3))
    assert most < 5000
    small(monkeypatch)
    words, asked = by_hand(nodes, queries)
    score = lambda terms, w: round(sum(w.count(t) / (1 + math.log(1 + len(w))) for t in terms), 9)
    every = {(name, p): score(terms, w) for name, terms in asked.items() for p, w in words.items() if terms and terms <= set(w)}
    first = {(name, p) for name in asked for _, p in sorted((-s, p) for (x, p), s in every.items() if x == name)[:3]}
    for rows in (got, retrieval.lexical_arm(n, q, 3).collect()):
        assert {(r.query, r.path): r.score for r in rows} == {x: pytest.approx(every[x], abs=1e-8) for x in first} and len(rows) == len(first)
    assert {(r.query, r.path) for r in retrieval.lexical_hits(n, q).collect()} == set(every)


def test_a_name_of_many_nodes_meets_two_of_them(spark):
    """300 nodes in three folders begin with each other's name; no step holds their 90,000 pairs."""
    paths = [f"/{'abc'[i % 3]}/same-{i:03}" for i in range(300)] + ["/d/same-x", "/d/lone"]
    names = [(p, "same") for p in paths] + [("/d/lone", "lone")]
    got, most = most_rows(linking.resolve_names(spark.createDataFrame(names, "path string, name string"), spark.createDataFrame([(p,) for p in paths], "path string")))
    first = lambda p: min(t for t in paths if t != p and t.startswith(p[:3]) and "same" in t)
    want = {(p, "same", "/a/same-000" if p == "/d/same-x" else first(p)) for p in paths}
    assert {tuple(r) for r in got} == want and most < 5000
