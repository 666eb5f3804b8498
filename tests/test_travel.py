"""What travels between tasks, and what is written, on the way from two arms to what is let through."""

import pytest
from pyspark.sql import functions as F

from loam import session
from loam.operators import gate, inverted, retrieval

from tests.test_inverted import by_hand, corpus


def all_sent(df):
    """The rows of df, and the number of rows that all exchanges of its plan sent."""
    def walk(plan):
        while (kind := plan.getClass().getSimpleName()) == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            plan = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan()
        rows = plan.metrics().get("shuffleRecordsWritten")
        yield rows.get().value() if rows.isDefined() else 0
        for i in range(plan.children().size()):
            yield from walk(plan.children().apply(i))

    return df.collect(), sum(walk(df._jdf.queryExecution().executedPlan()))


def arms(spark, name="lex_conf"):
    """30 queries, each with 20 nodes of the first arm and 20 of the second, of which 10 are the same."""
    row = lambda q, i, v: (f"q{q:02}", f"/n{i:02}", v / 100, 0.9)
    a = spark.createDataFrame([row(q, i, 40 + i) for q in range(30) for i in range(20)], f"query string, path string, {name} double, importance double")
    b = spark.createDataFrame([row(q, i, 99 - i) for q in range(30) for i in range(10, 30)], "query string, path string, sim double, importance double")
    return a, b


def candidates(spark):
    return gate.merge_signals(*arms(spark), ["importance"]).withColumn("in_project", F.lit(False))


def test_selected_candidates_travel_once(spark):
    got, sent = all_sent(gate.select_hits(gate.learned_confidence(gate.add_features(candidates(spark))), 0.0))
    assert {(r.query, r.path, r.lex_conf, r.sim) for r in got} == {(f"q{q:02}", "/n10", 0.5, 0.89) for q in range(30)} and len(got) == 30
    assert sent == 1200


@pytest.mark.parametrize("slices", [2, 500_000])
def test_words_become_codes_where_they_are_read(spark, monkeypatch, slices):
    """Terms are looked up in one slice or in many; a block holds its nodes in order; texts aren't written."""
    monkeypatch.setattr(inverted, "SLICE", slices)
    monkeypatch.setattr(inverted, "BLOCK", 40)
    nodes, queries, n, q = corpus(spark)
    words, asked = by_hand(nodes, queries)
    index = retrieval._lexical_index(n.repartition(5).withColumn("importance", F.length("path")), q, ["importance"])
    assert {r.df for r in index.doc_freqs().collect()} == {sum(t in w for w in words.values()) for t in set().union(*asked.values())} - {0}
    names = index.names.orderBy("node").collect()
    assert [r.path for r in names] == sorted(words) and {r.importance for r in names} == {5} and index.nodes == len(nodes)
    got = {(r.query, r.path) for r in retrieval.lexical_hits(n, q).collect()}
    assert got == {(name, p) for name, terms in asked.items() for p, w in words.items() if terms and terms <= set(w)}
    tables = [f for f in session._WRITTEN[-6:] if "body" in spark.read.parquet(f).columns or "w" in spark.read.parquet(f).columns]
    assert not tables


def test_fused_rows_travel_once(spark):
    got, sent = all_sent(retrieval.fuse(*arms(spark, "score"), keep=["importance"]))
    assert sent == 1200 and len(got) == 900 and {r.importance for r in got} == {0.9}
    one = {r.path: r for r in got if r.query == "q07"}
    assert one["/n19"].rrf == pytest.approx(1 / 61 + 1 / 70) and one["/n00"].rrf == pytest.approx(1 / 80 + 1 / 81) and one["/n10"].rrf == pytest.approx(1 / 70 + 1 / 61)
    assert {(r.na, r.nb) for r in got} == {(20, 20)} and sum(r.in_lexical and r.in_vector for r in one.values()) == 10


def test_a_sweep_sends_candidates_and_gold_once(spark):
    gold = spark.createDataFrame([(f"q{q:02}", ["/n10"] if q % 2 else ["/n09"], []) for q in range(40)], "query string, expected array<string>, acceptable array<string>")
    scored = candidates(spark).withColumn("confidence", F.greatest("lex_conf", F.coalesce("sim", F.lit(0.0))))
    got, sent = all_sent(gate.sweep(gold, scored, [i / 20 for i in range(1, 20)]))
    assert {(r.threshold, r.recall, r.precision, r.injection_rate) for r in got} == {(i / 20, 15 / 40 if i < 18 else 0.0, 0.5 if i < 18 else 1.0, 0.75 if i < 18 else 0.0) for i in range(1, 20)}
    assert 1200 < sent < 1300


def tables(spark, query):
    """The columns of the tables that a query writes to the shared folder."""
    from loam.plans import search

    at = len(session._WRITTEN)
    search.QUERIES[query](spark, "/root/testdata/sf0.001")
    return [spark.read.parquet(f).columns for f in session._WRITTEN[at:]]


@pytest.mark.parametrize("query", ["frontier", "param_sweep", "gate_failures"])
def test_scored_candidates_arent_written(spark, query):
    assert (written := tables(spark, query)) and not any("confidence" in columns for columns in written)


def test_links_of_other_nodes_dont_travel(spark, tmp_path):
    """100 links, 4 of them of the only query node, in either direction and letter case, one delivered twice."""
    from loam.plans import search

    node = lambda i, kind: (f"a{i}", f"/n{i:02}", kind, "curated", None, None)
    spark.createDataFrame([node(0, "feedback"), *(node(i, "note") for i in range(1, 40))], "id string, path string, type string, origin string, valid_until timestamp_ntz, deleted_at timestamp_ntz").write.parquet(f"{tmp_path}/memory_nodes.parquet")
    ends = [("A0", "a1"), ("a2", "a0"), ("a0", "A3"), ("a0", "gone")] + [(f"a{1 + i % 38}", f"a{2 + i % 38}") for i in range(96)]
    spark.createDataFrame([(f"l{i}", *x, "about") for i, x in enumerate([*ends])] + [("l0", "a0", "A1", "about")], "id string, from_id string, to_id string, rel_type string").write.parquet(f"{tmp_path}/memory_links.parquet")
    got, sent = all_sent(search._gold(spark, str(tmp_path)))
    assert [(r.query, sorted(r.expected)) for r in got] == [("/n00", ["/n01", "/n02", "/n03"])]
    assert sent < 90


def test_folds_are_read_from_one_table(spark):
    gold = spark.createDataFrame([(f"q{q:02}", ["/n10"] if q % 2 else ["/n09"], []) for q in range(30)], "query string, expected array<string>, acceptable array<string>")
    featured = gate.add_features(candidates(spark)).localCheckpoint()
    at = len(session._WRITTEN)
    assert gate.cross_validate(gold, featured, 3).count() == 900
    assert len(session._WRITTEN) == at + 1


def test_candidates_stay_where_they_are_without_some(spark):
    gone, told = spark.createDataFrame([("/n10",), ("/n10",)], "path string"), spark.createDataFrame([("q00", "/n11"), ("q00", "/n12"), ("q01", "/n13")], "query string, path string")
    got, sent = all_sent(gate.select_hits(gate.without(candidates(spark), gone, told).withColumn("confidence", F.col("lex_conf")), 0.0, gate.GateParams(max_hits=99)))
    assert len(got) == 30 * 29 - 3 and not {("q00", "/n11"), ("q00", "/n12"), ("q01", "/n13"), ("q02", "/n10")} & {(r.query, r.path) for r in got}
    assert 1200 <= sent < 1220
