import importlib
import subprocess
import sys
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions import paths as ps
from loam.functions import text as tx
from loam.functions.vector import cosine, normalize
from loam.operators import consolidate, gate, journal, linking, mutate, retrieval, stats, sync
from loam.sources import files
from loam.streaming import jobs

T = [datetime(2024, 1, d) for d in range(1, 28)]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_fusion_ranks(spark):
    lex = spark.createDataFrame([("q", "A", 3.0), ("q", "C", 2.0), ("q", "D", 1.0)], "query string, path string, score double")
    vec = spark.createDataFrame([("q", "C", 0.9), ("q", "B", 0.8), ("q", "D", 0.7)], "query string, path string, sim double")
    got = {r.path: r.rrf for r in retrieval.fuse(lex, vec).collect()}
    assert got["C"] > got["A"] > got["B"] and got["A"] == pytest.approx(1 / 61 + 1 / 64)


def test_same_first_rank_in_both(spark):
    lex = spark.createDataFrame([("q", "A", 3.0)], "query string, path string, score double")
    vec = spark.createDataFrame([("q", "A", 0.3)], "query string, path string, sim double")
    assert retrieval.fuse(lex, vec).first().rrf == pytest.approx(2 / 61)


def test_vector_functions(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, cosine(v(1.0, 0.0), v(1.0)).alias("a"), cosine(v(0.0, 0.0), v(1.0, 0.0)).alias("b"), normalize(v(0.0, 0.0)).alias("c"), cosine(v(1.0, 0.0), v(0.6, 0.8)).alias("d"))
    assert (r.a, r.b, r.c) == (0.0, 0.0, [0.0, 0.0]) and r.d == pytest.approx(0.6)


NODE = "path string, title string, body string, importance float, updated_at timestamp_ntz, embedding array<double>"


def test_hybrid_falls_back_per_query(spark):
    nodes = spark.createDataFrame([("/a", "index rebuild", "the nightly index", 1.0, T[1], [1.0, 0.0]), ("/b", "other", "xyzzy-42 here", 1.0, T[2], [0.0, 1.0]), ("/c", None, None, None, None, None), ("/d", "z", "z", 0.5, T[3], [0.0, 0.0])], NODE)
    q = spark.createDataFrame([("both", "nightly index", [0.9, 0.1]), ("vector", "nowhere", [0.0, 2.0]), ("plain", "zzy-4", None), ("none", "absent", None), ("empty", "", None)], "query string, text string, vector array<double>")
    got = retrieval.hybrid(nodes, q, "2024-02-01 00:00:00").filter("position = 1").collect()
    assert {r.query: r.path for r in got} == {"both": "/a", "vector": "/b", "plain": "/b"}
    assert {r.query: r.retrieval_score for r in got}["plain"] == 0.1


def test_empty_nodes_find_nothing(spark):
    q = spark.createDataFrame([("q", "words here", [1.0])], "query string, text string, vector array<double>")
    assert retrieval.hybrid(spark.createDataFrame([], NODE), q, "2024-02-01 00:00:00").count() == 0


def test_margins(spark):
    rows = [("q", "a", 0.5, 0.8, 0.5, True), ("q", "b", 0.9, 0.6, 0.5, False), ("q", "c", 0.0, None, 0.5, None)]
    f = gate.add_features(spark.createDataFrame(rows, "query string, path string, lex_conf double, sim double, importance double, in_project boolean"))
    got = {r.path: r for r in f.collect()}
    assert got["a"].f_sem_margin == pytest.approx(0.2) and got["b"].f_lex_margin == pytest.approx(0.4) and got["b"].f_sem_margin == pytest.approx(-0.2)
    assert got["c"].f_sem_margin == pytest.approx(-0.8) and got["c"].f_lex_margin == 0.0 and got["a"].f_sem_top == 1.0
    scored = gate.learned_confidence(f)
    assert gate.select_hits(scored, 0.0).count() == 1 and gate.near_miss(scored, 1.1).first().reason == "below threshold"


def test_threshold_gate_and_importance(spark):
    rows = [("q", p, 0.95, None, i, False) for p, i in (("/a", 0.5), ("/b", 0.5), ("/c", 0.3), ("/d", 0.5))]
    c = gate.threshold_confidence(spark.createDataFrame(rows, "query string, path string, lex_conf double, sim double, importance double, in_project boolean"))
    assert [r.path for r in gate.select_hits(c, 0.9).collect()] == ["/a"]


def test_evaluation(spark):
    gold = spark.createDataFrame([("1", ["/a"], ["/x"]), ("2", ["/b"], []), ("3", [], [])], "query string, expected array<string>, acceptable array<string>")
    hits = spark.createDataFrame([("1", "/a"), ("3", "/z")], "query string, path string")
    m = gate.evaluate(gold, hits).first()
    assert (m.recall, m.precision, m.false_positive_rate) == (0.5, 0.5, 1.0)
    assert gate.evaluate(gold, hits.limit(0)).first().precision == 1.0


def _gold_rows(spark, n=20):
    """Positive queries whose first candidate fits, and one that doesn't for each."""
    full = lambda **f: tuple(float(f.get(x, 0.0)) for x in gate.FEATURES)
    rows = [(f"q{i:02}", p, 0.9, *full(sim=s, lex=s, sem_top=s > 0.5, lex_top=s > 0.5, importance=0.9)) for i in range(n) for p, s in ((f"/a{i}", 0.9), (f"/b{i}", 0.1))]
    featured = spark.createDataFrame(rows, "query string, path string, importance double, " + ", ".join(f"f_{f} double" for f in gate.FEATURES))
    gold = spark.createDataFrame([(f"q{i:02}", [f"/a{i}"], []) for i in range(n)], "query string, expected array<string>, acceptable array<string>")
    return gold, featured


def test_gate_fit_and_cross_validation(spark):
    gold, featured = _gold_rows(spark)
    model = gate.fit(gate.labelled(gold, featured))
    probs = {r.path: r.confidence for r in gate.learned_confidence(featured, model).collect()}
    assert all((p > 0.8) if path.startswith("/a") else (p < 0.2) for path, p in probs.items())
    m = gate.evaluate(gold, gate.select_hits(gate.cross_validate(gold, featured, 5), 0.5)).first()
    assert (m.recall, m.precision) == (1.0, 1.0)
    assert gate.fit(gate.labelled(gold, featured.limit(0))) == gate.GateModel()


def test_gate_fit_is_the_least_loss(spark):
    from loam.operators import logistic

    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = (1 / (1 + np.exp(-(x @ [1.5, -0.4, 2.0] - 1))) > rng.random(300)).astype(int)
    rows = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "u double, v double, w double, y int").cache()
    for standardise, non_negative in ((False, False), (True, True)):
        got = logistic.fit(rows, ["u", "v", "w"], "y", 1.0, standardise, non_negative)
        m, s = (x.mean(0), x.std(0) + 1e-9) if standardise else (np.zeros(3), np.ones(3))
        z, w, b = (x - m) / s, np.zeros(3), 0.0
        for _ in range(60000):
            p = 1 / (1 + np.exp(-(z @ w + b)))
            w = w - 0.05 * (z.T @ (p - y) + w) / 300
            w = np.maximum(w, 0) if non_negative else w
            b -= 0.05 * (p - y).mean()
        assert np.allclose([got[f] for f in "uvw"], w / s, atol=2e-3) and abs(got["bias"] - (b - (w / s) @ m)) < 5e-3
        assert not non_negative or got["v"] == 0.0


def test_link_fit_needs_forty_deliberate_links(spark):
    rows = [(int(i % 2 == 0), float(i % 2 == 0), 0.0, (i * 7 % 5) / 5, 0.0, 0.0, 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "y int, " + ", ".join(f"{f} double" for f in linking.FEATURES))
    weights, source = linking.fit(df)
    assert source == "trained" and weights["semantic"] > 0 and min(v for k, v in weights.items() if k != "bias") >= 0
    assert linking.fit(df.limit(60)) == (dict(linking.WEIGHTS), "default") and linking.fit(df.filter("y = 1"))[1] == "default"


def test_labels_of_links(spark):
    named = spark.createDataFrame([("b", "a", "explicit"), ("c", "d", "inferred"), ("e", "f", "explicit")], "from_path string, to_path string, link_origin string")
    pairs = spark.createDataFrame([("a", "b"), ("c", "d"), ("x", "y"), ("g", "h")], "a string, b string")
    told = spark.createDataFrame([("h", "g"), ("e", "f")], "path string, mentioned string")
    assert {tuple(r) for r in linking.labelled(named, pairs, told).collect()} == {("a", "b", 1), ("c", "d", 0), ("x", "y", 0)}


def test_grid_and_failures(spark):
    gold = spark.createDataFrame([("1", ["/a"], []), ("2", [], [])], "query string, expected array<string>, acceptable array<string>")
    cands = spark.createDataFrame([("1", "/a", 0.8, 0.6, 0.9), ("1", "/b", 0.1, None, 0.9), ("2", "/c", 0.9, None, 0.9)], "query string, path string, lex_conf double, sim double, importance double")
    settings = [gate.GateParams(min_confidence=c, sim_zero=z) for c in (0.1, 0.85, 0.95) for z in (0.5, 0.59)]
    got = gate.grid(gold, cands, settings).collect()
    for r in got:
        p = settings[r.setting]
        want = gate.evaluate(gold, gate.select_hits(gate.threshold_confidence(cands, p), p.min_confidence, p)).first()
        assert (r.recall, r.precision, r.false_positive_rate, r.injection_rate) == tuple(want) and r.min_confidence == p.min_confidence
    assert len(got) == 6 and gate.recommend(gate.grid(gold, cands, settings)).count() == 1
    scored = gate.threshold_confidence(cands)
    assert {(r.query, r.kind, r.path) for r in gate.failures(gold, scored, 0.9).collect()} == {("1", "missed", "/a"), ("1", "missed", "/b"), ("2", "wrong", "/c")}
    assert gate.candidate_pool(scored).count() == 3
    frontier = {r.threshold: r.recall for r in gate.sweep(gold, scored, [0.5, 0.9]).collect()}
    assert frontier == {0.5: 1.0, 0.9: 0.0}
    gone, told = spark.createDataFrame([("/a",)], "path string"), spark.createDataFrame([("2", "/c")], "query string, path string")
    assert [r.path for r in gate.without(cands, gone, told).collect()] == ["/b"]


def test_never_used(spark):
    rows = [("/projects/a", False)] * 3 + [("/projects/b", False)] * 2 + [("/projects/b", True)] + [("/feedback", False)] * 3 + [("/projects/c", None)] * 3
    got = gate.never_used(spark.createDataFrame(rows, "path string, used boolean"))
    assert sorted(r.path for r in got.collect()) == ["/projects/a", "/projects/c"]


def test_mentions(spark):
    nodes = spark.createDataFrame([("/projects/p/one", "see /projects/p/two."), ("/projects/p/two", "[[one]] and [[dup]]"), ("/projects/p/dup", None), ("/projects/q/dup", ""), ("/notes/n", "[[dup]]")], "path string, body string")
    assert {tuple(r) for r in linking.mentions(nodes).collect()} == {("/projects/p/one", "/projects/p/two"), ("/projects/p/two", "/projects/p/one"), ("/projects/p/two", "/projects/p/dup")}


def test_spine_joins_a_project(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.7), ("c", "d", 0.1), ("d", "z", 1.0)], "a string, b string, confidence double")
    members = spark.createDataFrame([("p", x) for x in "abcd"] + [("q", "z")], "project string, path string")
    none = spark.createDataFrame([], "a string, b string")
    run = lambda known, rejected: {(r.project, r.a, r.b) for r in linking.spine(pairs, members, known, rejected).collect()}
    assert run(none, none) == {("p", "a", "b"), ("p", "b", "c"), ("p", "c", "d")}
    one = spark.createDataFrame([("a", "c")], "a string, b string")
    assert run(one, none) == {("p", "a", "b"), ("p", "c", "d")}
    assert run(none, spark.createDataFrame([("a", "b")], "a string, b string")) == {("p", "b", "c"), ("p", "a", "c"), ("p", "c", "d")}


@pytest.mark.parametrize("seed", range(3))
def test_spine_is_kruskals(spark, seed):
    rng = np.random.default_rng(seed)
    names = [f"n{i:02}" for i in range(30)]
    rows = [(a, b, float(rng.integers(0, 5)) / 5) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.2]
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = set()
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b))
    members = spark.createDataFrame([("p", x) for x in names], "project string, path string")
    none = spark.createDataFrame([], "a string, b string")
    assert {(r.a, r.b) for r in linking.spine(spark.createDataFrame(rows, "a string, b string, confidence double"), members, none, none).collect()} == want


def test_pairs_for_a_spine_always_connect(spark):
    members = spark.createDataFrame([("p", x) for x in "abcd"] + [("q", "z")], "project string, path string")
    some = spark.createDataFrame([("b", "c"), ("c", "z")], "a string, b string")
    assert {tuple(r) for r in linking.spine_pairs(members, some).collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")}
    assert linking.spine_pairs(members, some, exact=True).count() == 6


def test_routing_holds_back_and_says_so(spark):
    scored = spark.createDataFrame([(f"a{i}", f"b{i}", 0.7 + i / 1e5) for i in range(1200)] + [("x", "y", 0.5), ("s", "t", 0.9)], "a string, b string, confidence double")
    named = spark.createDataFrame([], "from_path string, to_path string, link_origin string, confidence double")
    settled = spark.createDataFrame([("s", "t")], "a string, b string")
    count = lambda df: {r.action: r["count"] for r in df.groupBy("action").count().collect()}
    assert count(linking.route(scored, named, settled)) == {"link": 1200, "suggest": 1}
    assert count(linking.route(scored, named, settled, most=1000)) == {"link": 1000, "held": 200, "suggest": 1}


def test_relative_dates(spark):
    text = "Gestern war es da, `heute` nicht.\n```\nmorgen\n```\nÜbermorgen, morgen früh und Morgen zählen nicht, gestern und übermorgen schon."
    r = one(spark, tx.relative_dates(F.lit(text), F.lit("2024-03-10").cast("date")).alias("d"))
    assert r.d == ["Gestern=2024-03-09", "gestern=2024-03-09", "übermorgen=2024-03-12"]
    r = one(spark, tx.rewrite_relative_dates(F.lit("Gestern und `gestern`, morgen früh."), F.lit("2024-03-10").cast("date")).alias("d"))
    assert r.d == "Gestern (2024-03-09) und `gestern`, morgen früh."


def test_titles_tags_headlines_and_trivial_prompts(spark):
    text = " ".join(f"w{i}" for i in range(60)) + " the Index here " + " ".join(f"v{i}" for i in range(60))
    r = one(spark, tx.headline(F.lit(text), ["index"]).alias("a"), tx.headline(F.lit("one two"), ["index"]).alias("b"), tx.title_of(F.lit("\n  \n First line \nmore")).alias("c"), tx.title_of(F.lit("x" * 200)).alias("d"), tx.title_of(F.lit(None).cast("string")).alias("e"), tx.tag_list(F.lit("a, B ,,b, c"), ["C", "d"]).alias("f"), F.array(*[tx.trivial_prompt(F.lit(x)) for x in ("/clear", "/run quartz lattice", "ok", "quartz lattice", None)]).alias("g"))
    assert "«Index»" in r.a and len(r.a.split()) == 25 and r.b == "one two" and r.c == "First line" and (len(r.d), r.d[-3:], r.e) == (120, "...", "")
    assert r.f == ["a", "B", "c", "d"] and r.g == [True, False, True, False, True]


def test_usage_of_what_was_shown(spark):
    words = {"/a": "quartz lattice symmetry", "/b": "river delta sediment", "/c": "violin string tension"}
    corpus = spark.createDataFrame([(p, "", w) for p, w in words.items()], "path string, title string, body string")
    replies = spark.createDataFrame([("1", "/a", "what now", "the quartz lattice has symmetry"), ("2", "/b", "what now", "violin tension"), ("3", "/c", "what", "see /c there"), ("4", "/none", "what", "quartz")], "query string, path string, prompt string, reply string")
    got = {r.query: (r.rank_share, r.used) for r in retrieval.judge(retrieval.usage_rank(corpus, replies), corpus).collect()}
    assert got == {"1": (round(1 / 3, 9), True), "2": (1.0, False), "3": (0.0, True), "4": (1.0, False)}


def test_text_columns(spark):
    r = one(spark, tx.first_sentence(F.lit("# Head\n\n- **First** one. Second.")).alias("a"), tx.slugify(F.lit("Ä b-C!! d")).alias("b"), tx.slugify(F.lit("!!")).alias("c"), tx.highlight(F.lit("The Index, indexes"), ["index"]).alias("d"), tx.redact_url(F.lit("postgres://me:pw@host/db")).alias("e"), tx.lexemes(F.lit(None).cast("string")).alias("f"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("First one.", "b-c-d", "turn", "The «Index», indexes", "postgres://***@host/db", [])


def test_paths(spark):
    df = spark.createDataFrame([("/projects/x/y",), ("/a",), ("/projects//b",), ("rel/../x",), (None,)], "p string")
    r = [tuple(x) for x in df.select(ps.parent_path(F.col("p")), ps.pinnable(F.col("p")), ps.incoming_path("/l", F.col("p")), ps.ancestors(F.col("p"))).collect()]
    assert r[0] == ("/projects/x", True, "/l/projects/x/y", ["/projects", "/projects/x"]) and r[1] == (None, False, "/l/a", []) and r[2][1:3] == (False, None) and r[3][2] is None and r[4][0] is None
    hit = df.filter(ps.in_subtree(F.col("p"), "/projects/x")).collect()
    assert [x.p for x in hit] == ["/projects/x/y"]


def test_digest_stops_and_packing_skips(spark):
    rows = [("p", f"/{i}", "x" * n, 0.9 - i / 10, 0, False) for i, n in enumerate((10, 50, 10))]
    df = spark.createDataFrame(rows, "project string, path string, body string, importance double, access_count int, recent boolean")
    assert [r.path for r in retrieval.digest(df, 40).collect()] == ["/0"]
    assert sorted(r.path for r in retrieval.pack_skipping(df, 25).collect()) == ["/0", "/2"]


def test_merge_and_conflicts(spark):
    s = "path string, title string, tags array<string>, created_at timestamp_ntz, updated_at timestamp_ntz"
    a = spark.createDataFrame([("/1", "l", [], T[0], T[5]), ("/2", "l", None, T[0], T[3]), ("/3", "l", None, T[0], T[4]), ("/5", "same", [], T[0], T[6])], s)
    b = spark.createDataFrame([("/1", "r", [], T[1], T[4]), ("/2", "r", None, T[1], T[6]), ("/4", "r", None, T[1], T[1]), ("/5", "same", None, T[0], T[7])], s)
    assert {r.path: r.action for r in sync.plan(a, b, ["path"]).collect()} == {"/1": "push", "/2": "pull", "/3": "push", "/4": "pull", "/5": "pull"}
    merged = {r.path: (r.title, r.created_at) for r in sync.merge(a, b, ["path"], ["title", "created_at"], insert_only=["created_at"]).collect()}
    assert merged["/2"] == ("r", T[0]) and merged["/4"] == ("r", T[1]) and merged["/1"][0] == "l"
    assert {r.path: r.winner for r in sync.conflicts(a, b, ["path"], ["title", "tags"], "2024-01-03 00:00:00").collect()} == {"/1": "local", "/2": "remote"}
    assert sync.conflicts(a, b, ["path"], ["title"], None).count() == 0
    again = sync.merge(a, b, ["path"], ["title", "tags", "created_at"])
    assert sync.plan(again, again, ["path"]).filter("action != 'keep'").count() == 0


def test_upsert_revives_and_keeps(spark):
    s = "path string, title string, provenance string, deleted_at timestamp_ntz"
    cur = spark.createDataFrame([("/a", "old", "user", T[0]), ("/b", "b", None, None)], s)
    new = spark.createDataFrame([("/a", "new", None, None), ("/c", "c", "import", None)], s)
    got = {r.path: tuple(r)[1:] for r in mutate.upsert(cur, new, "path", keep_if_null=["provenance"]).collect()}
    assert got == {"/a": ("new", "user", None), "/b": ("b", None, None), "/c": ("c", "import", None)}


def test_merge_nodes_and_links(spark):
    nodes = spark.createDataFrame([("1", "/a", "x", None), ("2", "/b", "y", None)], "id string, path string, body string, deleted_at timestamp_ntz")
    links = spark.createDataFrame([("l1", "2", "3", "related"), ("l2", "1", "3", "related"), ("l3", "1", "2", "related")], "id string, from_id string, to_id string, rel_type string")
    n, l = mutate.merge_nodes(nodes, links, "1", "2", "2024-01-09 00:00:00")  # noqa: E741
    rows = {r.id: r for r in n.collect()}
    assert rows["1"].body == "x\n\n--- from /b\n\ny" and rows["2"].deleted_at is not None
    assert [(r.id, r.from_id, r.to_id) for r in l.collect()] == [("l2", "1", "3")]


def test_symmetric_links_are_promoted(spark):
    s = "from_id string, to_id string, rel_type string, link_origin string"
    links = spark.createDataFrame([("a", "b", "related", "inferred"), ("a", "b", "requires", "inferred")], s)
    new = spark.createDataFrame([("b", "a", "related"), ("b", "a", "requires")], "from_id string, to_id string, rel_type string")
    got = sorted(map(tuple, mutate.add_links(links, new).collect()))
    assert got == [("a", "b", "related", "explicit"), ("a", "b", "requires", "inferred"), ("b", "a", "requires", "explicit")]


def test_duplicates_keep_the_more_important(spark):
    rows = [("/a", 0.6, 0, T[0], [1.0, 0.0]), ("/b", 0.9, 0, T[0], [0.999, 0.0447]), ("/c", None, None, None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "path string, importance float, access_count int, updated_at timestamp_ntz, embedding array<double>")
    assert [(r.keep, r.drop) for r in consolidate.duplicates(df, 0.93, 2).collect()] == [("/b", "/a")]


def test_due_words_and_folders(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-02-05",), ("2024-01-05 10:30",), ("soon",), (None,)], "d string")
    assert [r[0] for r in df.select(journal.due(F.col("d"), "2024-01-10 00:00:00")).collect()] == [True, False, True, False, False]
    assert [r[0] for r in df.select(mutate.snooze(F.col("d"), 3)).collect()] == ["2024-01-08", "2024-02-08", "2024-01-08 10:30", "soon", None]
    c = spark.createDataFrame([("/w/a/b/c",), ("/w/ab",), ("/w/a",)], "cwd string")
    p = spark.createDataFrame([("one", "/w/a"), ("two", "/w/a/b/")], "project string, dir string")
    assert {r.cwd: r.project for r in journal.project_of_folder(c, p).collect()} == {"/w/a/b/c": "two", "/w/a": "one"}


def test_streaks_and_levels(spark):
    d = spark.createDataFrame([(T[i].date(), n) for i, n in enumerate((1, 2, 0, 3, 4, 5, 0))], "day date, n long")
    assert sorted(r.length for r in stats.streaks(d).collect()) == [2, 3]
    assert {r.n: r.level for r in stats.levels(d).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    assert stats.levels(d).filter("n = 0 and level != 0").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event": "prompt", "session": "s", "hits": ["/a"]}\nnot json\n{"event": "start"}\n')
    assert files.read_events(spark, f"{tmp_path}/log.jsonl").count() == 2
    assert files.read_events(spark, f"{tmp_path}/none.jsonl").count() == 0
    (tmp_path / "gold.jsonl").write_text('// note\n\n{"prompt": "p", "expected": ["/a"]}\n')
    assert files.read_gold(spark, f"{tmp_path}/gold.jsonl").first().expected == ["/a"]
    (tmp_path / "bad.jsonl").write_text('{"slug": "x"}\n')
    with pytest.raises(Exception, match="gold line"):
        files.read_gold(spark, f"{tmp_path}/bad.jsonl").collect()
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "some file.md").write_text("---\nname: Hello\ntype: feedback\nimportance: high\n---\nBody\n")
    r = files.read_memory_files(spark, f"{tmp_path}/m/*.md").first()
    assert (r.title, r.type, r.importance, r.body) == ("Hello", "feedback", 0.5, "Body")
    (tmp_path / "t.jsonl").write_text('{"type":"user","message":{"role":"user","content":"What is it?"}}\n{"type":"attachment"}\n{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"This."},{"type":"tool_use","name":"x"}]}}\n')
    assert [(r.role, r.text) for r in files.read_transcript(spark, f"{tmp_path}/t.jsonl").orderBy("turn").collect()] == [("user", "What is it?"), ("assistant", "This.")]


def test_queue_is_drained_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"project":"p","level":"error","message":"boom"}\n{"project":"","message":"x"}\n{"project":"p","message":"ok"}\n')
    for _ in range(2):
        q = jobs.ingest_queue(jobs.read_folder(spark, f"{tmp_path}/in", jobs.QUEUE), f"{tmp_path}/out", f"{tmp_path}/cp")
        assert q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out/logs").count() == 2 and spark.read.parquet(f"{tmp_path}/out/errors").count() == 1


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['loam.llm'] = None\nimport __spark_entry__ as e\nassert 'p3_found' in e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=importlib.import_module("loam").__path__[0] + "/..").returncode == 0
