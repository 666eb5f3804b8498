from pyspark.sql import functions as F

from loam.operators import journal, retrieval


def test_more_queries_than_a_driver_should_hold(spark):
    """20,500 queries, which are never collected; pieces of a query's text shorter and longer than the index key."""
    nodes = spark.createDataFrame([("/a", "indexed lattice", None, [1.0, 0.0]), ("/b", "other", "x\nLatt", [0.0, 1.0]), ("/c", None, None, None)], "path string, title string, body string, embedding array<double>")
    q = spark.range(20_500).select(F.concat(F.lit("q"), "id").alias("query"), F.lit("Ndexed latt").alias("text"), F.array(F.lit(1.0), F.lit(0.1)).alias("vector"))
    got = retrieval.vector_arm(nodes, q, 1, dims=2)
    assert [tuple(r) for r in got.groupBy("path").count().collect()] == [("/a", 20_500)]
    assert [tuple(r) for r in retrieval.substring_arm(nodes, q).groupBy("path").count().collect()] == [("/a", 20_500)]
    few = spark.createDataFrame([("1", "LATT"), ("2", "x"), ("3", ""), ("4", None), ("5", "lattice other"), ("6", "x\nlatt")], "query string, text string")
    assert {tuple(r) for r in retrieval.substring_arm(nodes, few).collect()} == {("1", "/a"), ("1", "/b"), ("2", "/a"), ("2", "/b"), ("6", "/b")}


def test_active_tasks_of_all_projects(spark):
    p = spark.createDataFrame([(1, "p", False, None)], "id int, name string, archived boolean, deleted_at timestamp_ntz")
    m = spark.createDataFrame([(2, 1, "m", None)], "id int, project_id int, title string, deleted_at timestamp_ntz")
    t = spark.createDataFrame([(3, 2, "t", False, None)], "id int, milestone_id int, title string, completed boolean, deleted_at timestamp_ntz")
    got = journal.active_tasks(p, m, t)
    assert [tuple(r) for r in got.collect()] == [("p", "m", 3, "t")] and "Limit" not in got._jdf.queryExecution().logical().toString()


def test_frequencies_are_kept_for_hours(spark, tmp_path):
    make = lambda *texts: spark.createDataFrame([(f"/{i}", "", t) for i, t in enumerate(texts)], "path string, title string, body string")
    read = lambda df, at: {r.term: (r.df, r.n) for r in retrieval.kept_frequencies(df, f"{tmp_path}/df", at).collect()}
    one, two = make("quartz lattice"), make("quartz", "quartz river")
    assert read(one, "2026-01-01 00:00:00") == {"quartz": (1, 1), "lattice": (1, 1)} == read(two, "2026-01-01 05:00:00")
    assert read(two, "2026-01-01 07:00:00") == {"quartz": (2, 2), "river": (1, 2)}


def test_names_resolve_near_before_far(spark):
    from loam.operators import linking

    nodes = spark.createDataFrame([("/p/alpha-one",), ("/q/alpha-two",), ("/q/beta",), ("/q/n",)], "path string")
    names = spark.createDataFrame([("/q/n", "alpha"), ("/p/alpha-one", "beta"), ("/q/n", "gamma"), ("/p/alpha-one", "alpha"), ("/q/n", "")], "path string, name string")
    assert {tuple(r) for r in linking.resolve_names(names, nodes).collect()} == {("/q/n", "alpha", "/q/alpha-two"), ("/p/alpha-one", "beta", "/q/beta"), ("/p/alpha-one", "alpha", "/q/alpha-two")}
