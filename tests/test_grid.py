from loam.operators import gate


def most_sent(df):
    """The rows of df, and the most rows that any exchange of its plan sent."""
    def walk(plan):
        while (kind := plan.getClass().getSimpleName()) == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            plan = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan()
        rows = plan.metrics().get("shuffleRecordsWritten")
        yield rows.get().value() if rows.isDefined() else 0
        for i in range(plan.children().size()):
            yield from walk(plan.children().apply(i))

    return df.collect(), max(walk(df._jdf.queryExecution().executedPlan()))


def test_candidates_are_sent_once_for_all_settings(spark):
    """600 candidates that pass all of 40 settings: 24,000 rows, which no exchange sends."""
    rows = [(f"q{i % 30:02}", f"/n{i:03}", 1.0, 0.9, 0.5 + (i % 7) / 20) for i in range(600)]
    candidates = spark.createDataFrame(rows, "query string, path string, lex_conf double, sim double, importance double")
    best = {q: min((-c[4], c[1]) for c in rows if c[0] == q)[1] for q in {c[0] for c in rows}}
    gold = spark.createDataFrame([(q, [p], []) for q, p in best.items()], "query string, expected array<string>, acceptable array<string>")
    got, most = most_sent(gate.grid(gold, candidates, [gate.GateParams(max_hits=1 + i % 2, min_confidence=i / 80) for i in range(40)]))
    assert len(got) == 40 and {(r.max_hits, r.recall, r.precision) for r in got} == {(1, 1.0, 1.0), (2, 1.0, 0.5)}
    assert 0 < most < 5000
