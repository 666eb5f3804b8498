"""Changes, decisions, sync, the journal's writes, settings, file sources and sinks, and streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loam import schemas, session
from loam.operators import consolidate, decisions, journal, mutate, stats, sync
from loam.sources import files
from loam.streaming import jobs

NOW = "2026-01-10 00:00:00"
AT = datetime(2026, 1, 10)
DAY = [datetime(2026, 1, d) for d in range(1, 31)]


def table(spark, name, rows):
    columns = [c.split(" ")[0] for c in schemas.SCHEMAS[name].split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schemas.SCHEMAS[name])


def node(path, **more):
    return {"id": path, "path": path, "type": "note", "origin": "curated", "importance": 0.5, "access_count": 0, "created_at": DAY[0], "updated_at": DAY[0]} | more


def by(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_schemas_settings_models_and_meta(spark, tmp_path):
    assert schemas.bootstrap(spark, str(tmp_path), {"projects": spark.createDataFrame([(1, "p", "x")], "id int, name string, extra string")}) == list(schemas.SCHEMAS)
    assert schemas.bootstrap(spark, str(tmp_path)) == [] and spark.read.parquet(f"{tmp_path}/projects.parquet").first()["name"] == "p"
    assert all(schemas.empty(spark, t).count() == 0 for t in schemas.SCHEMAS)
    got = schemas.conform(spark.createDataFrame([("7", "x")], "id string, junk string"), "projects").first()
    assert got.id == 7 and got.name is None
    path = f"{tmp_path}/settings"
    assert schemas.load_settings(spark, path, {"a": 1}) == {"a": 1}
    schemas.save_json(spark, path, {"b": 2, "a": 3})
    assert schemas.load_settings(spark, path, {"a": 1, "c": 4}) == {"a": 3, "b": 2, "c": 4}
    schemas.save_json(spark, path, {"bias": -1, "f": 2.5})
    assert schemas.load_weights(spark, path, ["f"], {"bias": 0.0}) == {"bias": -1.0, "f": 2.5}
    assert schemas.load_weights(spark, path, ["g"], {"bias": 0.0}) == {"bias": 0.0} == schemas.load_weights(spark, path + "x", ["f"], {"bias": 0.0})
    meta = schemas.put_meta(schemas.put_meta(schemas.empty(spark, "meta"), {"a": "1", "b": "2"}, NOW), {"a": "3"}, NOW)
    assert by(meta, "key", "value") == {"a": "3", "b": "2"}
    run = schemas.run_summary(spark.createDataFrame([("link",), ("link",), ("suggest",)], "action string"), NOW).first()
    assert run.value == NOW + ' {"link":2,"suggest":1}'


def test_ancestors_are_added_and_revived(spark):
    n = table(spark, "memory_nodes", [node("/a", deleted_at=DAY[1]), node("/a/b/c"), node("/x/y", deleted_at=DAY[1])])
    got = by(mutate.ensure_ancestors(n, NOW), "path", "type", "deleted_at")
    assert got == {"/a": ("note", None), "/a/b": ("category", None), "/a/b/c": ("note", None), "/x/y": ("note", DAY[1])}


def test_saving(spark):
    n = table(spark, "memory_nodes", [node("/p", provenance="user"), node("/p/gone", deleted_at=DAY[1]), node("/p/cur", title="kept")])
    change = spark.createDataFrame([("/p", "new", None), ("/p/gone", "back", "import"), ("/q/r", "made", None)], "path string, title string, provenance string")
    got = {r.path: r for r in mutate.save_nodes(n, change, NOW).collect()}
    assert set(got) == {"/p", "/p/gone", "/p/cur", "/q", "/q/r"} and got["/p"].provenance == "user" and got["/p"].created_at == DAY[0] and got["/p"].updated_at == AT
    assert got["/p/gone"].deleted_at is None and got["/q/r"].id and got["/p"].id == "/p"
    texts = spark.createDataFrame([("/p/cur", "t", "b"), ("/p/auto/t", "t", "b")], "path string, title string, body string")
    got = {r.path: r for r in mutate.save_extracted(n, texts, NOW).collect()}
    assert got["/p/cur"].title == "kept" and got["/p/auto/t"].origin == "extracted" and got["/p/auto/t"].valid_until == AT + timedelta(days=90) and abs(got["/p/auto/t"].importance - 0.3) < 1e-6


def test_pins_folders_promotion_and_purge(spark):
    n = table(spark, "memory_nodes", [node("/projects/p", config='{"dirs":["/w"],"n":3,"s":"a\\"b","o":{"x":[1]}}'), node("/projects/p/a"), node("/notes/b"), node("/e", origin="extracted", valid_until=DAY[20]), node("/old", deleted_at=datetime(2025, 1, 1))])
    paths = spark.createDataFrame([("/projects/p/a",), ("/notes/b",)], "path string")
    pinned = mutate.pin(n, paths, ["start"], NOW)
    assert {k: v for k, v in by(pinned, "path", "pin_triggers").items() if v} == {"/projects/p/a": ["start"]}
    assert by(mutate.pin(pinned, paths, [], NOW), "path", "pin_triggers")["/projects/p/a"] == []
    more = mutate.set_folder(n, "p", "/v")
    assert json.loads(by(more, "path", "config")["/projects/p"]) == {"dirs": ["/w", "/v"], "n": 3, "s": 'a"b', "o": {"x": [1]}}
    assert json.loads(by(mutate.set_folder(more, "p", "/w", False), "path", "config")["/projects/p"])["dirs"] == ["/v"]
    up = {r.path: r for r in mutate.promote(n, "/e").collect()}["/e"]
    assert up.origin == "curated" and up.valid_until is None
    l = table(spark, "memory_links", [{"id": "1", "from_id": "/old", "to_id": "/e", "rel_type": "related"}, {"id": "2", "from_id": "/e", "to_id": "/notes/b", "rel_type": "related"}])  # noqa: E741
    kept, links = mutate.purge(n, l, NOW)
    assert "/old" not in by(kept, "path", "id") and [r.id for r in links.collect()] == ["2"]
    seeded = mutate.seed_missing(spark.createDataFrame([("/e",), ("/seed",)], "path string"), n)
    assert seeded.count() == 6
    values = mutate.set_values(n, F.col("path") == "/e", {"title": F.lit("t")})
    assert by(values, "path", "title")["/e"] == "t"
    p = table(spark, "projects", [{"id": 1, "name": "p", "config": '{"a":"1"}'}, {"id": 2, "name": "q", "config": "broken"}])
    assert [json.loads(r.config) for r in mutate.edit_config(mutate.edit_config(p, "p", {"b": "2"}), "q", {"c": "3"}).orderBy("id").collect()] == [{"a": "1", "b": "2"}, {"c": "3"}]


def test_merging_many_pairs(spark):
    n = table(spark, "memory_nodes", [node("/a", body="A"), node("/b", body="B"), node("/c"), node("/d", body="D"), node("/x")])
    l = table(spark, "memory_links", [{"id": str(i), "from_id": f, "to_id": t, "rel_type": "related"} for i, (f, t) in enumerate([("/b", "/x"), ("/a", "/x"), ("/a", "/b"), ("/d", "/b"), ("/c", "/x")])])  # noqa: E741
    got, links = mutate.merge_pairs(n, l, spark.createDataFrame([("/a", "/b"), ("/c", "/d")], "keep string, drop string"), NOW)
    rows = {r.path: r for r in got.collect()}
    assert rows["/a"].body == "A\n\n--- from /b\n\nB" and rows["/c"].body == "--- from /d\n\nD" and rows["/b"].deleted_at == AT == rows["/d"].deleted_at and rows["/x"].updated_at == DAY[0]
    assert {(r.from_id, r.to_id) for r in links.collect()} == {("/a", "/x"), ("/c", "/a"), ("/c", "/x")}


def proposals(spark, n, kinds):
    rows = [(k, list(p), "", f"f{i}") for i, (k, p) in enumerate(kinds)]
    return decisions.stamped(spark.createDataFrame(rows, "kind string, paths array<string>, extra string, fingerprint string"), n, NOW)


def test_decisions_on_proposals(spark):
    n = table(spark, "memory_nodes", [node("/exp", valid_until=DAY[0]), node("/stale"), node("/date", body="Seen yesterday, `today`."), node("/k1", body="x"), node("/d1", body="y"), node("/k2"), node("/d2"), node("/moved"), node("/rej")])
    none = schemas.empty(spark, "memory_links")
    q = proposals(spark, n, [("expired", ["/exp"]), ("stale", ["/stale"]), ("relative_dates", ["/date"]), ("duplicate", ["/k1", "/d1"]), ("duplicate", ["/k2", "/d2"]), ("stale", ["/moved"]), ("stale", ["/rej"]), ("stale", ["/k1"]), ("expired", ["/d2"])])
    q = session.materialize(q)
    later = n.withColumn("updated_at", F.when(F.col("path") == "/moved", F.lit(NOW).cast("timestamp_ntz")).otherwise(F.col("updated_at")))
    told = spark.createDataFrame([("f0", "delete"), ("f1", "archive"), ("f2", "rewrite"), ("f3", "merge"), ("f4", "supersede"), ("f5", "archive"), ("f6", "reject"), ("f7", "archive"), ("unknown", "reject")], "fingerprint string, decision string")
    after, nodes, links = decisions.decide(q, later, none, told, NOW)
    assert by(after, "fingerprint", "status") == {"f0": "applied", "f1": "applied", "f2": "applied", "f3": "applied", "f4": "applied", "f5": "outdated", "f6": "rejected", "f7": "pending", "f8": "pending"}
    got = {r.path: r for r in nodes.collect()}
    assert got["/exp"].deleted_at == AT and got["/stale"].valid_until == AT and got["/moved"].valid_until is None and got["/rej"].updated_at == DAY[0]
    assert got["/date"].body == "Seen 2025-12-31, `today`." and got["/k1"].body == "x\n\n--- from /d1\n\ny" and got["/d1"].deleted_at == AT
    assert got["/d2"].valid_until == AT and got["/d2"].deleted_at is None
    assert [(r.from_id, r.to_id, r.rel_type, r.link_origin) for r in links.collect()] == [("/k2", "/d2", "supersedes", "explicit")]
    again = decisions.decide(session.materialize(after), nodes, links, told, NOW)[0]
    assert by(again, "fingerprint", "status")["f7"] == "outdated"  # the merge changed its node
    assert {r.fingerprint for r in decisions.history(after).collect()} == {f"f{i}" for i in range(7)}
    assert by(consolidate.unchanged(q, later), "fingerprint", "ok")["f5"] is False
    assert [r.kind for r in consolidate.pending(after.filter("status = 'pending'"), ["expired", "stale"]).collect()] == ["expired", "stale"]
    with pytest.raises(Exception, match="not allowed"):
        decisions.decide(q, n, none, spark.createDataFrame([("f0", "merge")], "fingerprint string, decision string"), NOW)


def test_decisions_on_suggestions(spark):
    n = table(spark, "memory_nodes", [node(f"/{x}", title=x, body=f"About {x}. More.") for x in "abcd"])
    ids = n.select("path", "id")
    scored = lambda rows: spark.createDataFrame(rows, "a string, b string, confidence double, evidence string")
    q = session.materialize(decisions.suggest(schemas.empty(spark, "link_suggestions"), scored([("/a", "/b", 0.5, "e"), ("/c", "/d", 0.4, "e")]), ids, NOW))
    q = session.materialize(decisions.suggest(q, scored([("/b", "/a", 0.6, "f"), ("/c", "/d", 0.40001, "e"), ("/a", "/d", 0.36, "g")]), ids, "2026-01-11 00:00:00"))
    assert {(r.from_id, r.to_id): (round(r.confidence, 3), r.evidence, r.updated_at.day) for r in q.collect()} == {("/a", "/b"): (0.6, "f", 11), ("/c", "/d"): (0.4, "e", 10), ("/a", "/d"): (0.36, "g", 11)}
    listed = decisions.pending_links(q, n, least=0.38, limit=1).collect()
    assert [(r.a_path, r.b_path, r.b_hook, r.total) for r in listed] == [("/a", "/b", "About b.", 3)]
    id_of = {(r.from_id, r.to_id): r.id for r in q.collect()}
    told = spark.createDataFrame([(id_of["/a", "/b"], "approve"), (id_of["/c", "/d"], "reject"), ("none", "approve")], "id string, decision string")
    after, links = decisions.decide_links(q, schemas.empty(spark, "memory_links"), told, NOW, "supports")
    assert {(r.from_id, r.to_id): r.status for r in after.collect()} == {("/a", "/b"): "approved", ("/c", "/d"): "rejected", ("/a", "/d"): "pending"}
    assert [(r.from_id, r.to_id, r.rel_type, r.link_origin, r.note) for r in links.collect()] == [("/a", "/b", "supports", "explicit", "confirmed suggestion (confidence 0.60)")]
    assert decisions.decide_links(after, links, told, NOW)[1].count() == 1
    with pytest.raises(ValueError):
        decisions.decide_links(q, links, told, NOW, "supersedes")


def test_sync_of_links(spark):
    n = lambda mark, paths: table(spark, "memory_nodes", [node(p, id=mark + p, deleted_at=gone) for p, gone in paths])
    local, remote = n("l", [("/a", None), ("/b", None), ("/c", DAY[1])]), n("r", [("/a", None), ("/b", None), ("/c", None), ("/d", None)])
    link = lambda i, a, b, kind, note, at: {"id": i, "from_id": a, "to_id": b, "rel_type": kind, "note": note, "updated_at": at}
    mine = table(spark, "memory_links", [link("1", "l/a", "l/b", "related", "old", DAY[0]), link("2", "l/b", "l/a", "related", "mine", DAY[5])])
    theirs = table(spark, "memory_links", [link("9", "r/a", "r/b", "related", "new", DAY[3]), link("8", "r/b", "r/a", "related", "late", DAY[4]), link("7", "r/a", "r/b", "supports", "more", DAY[1]), link("6", "r/a", "r/c", "related", "gone", DAY[1]), link("5", "r/a", "r/d", "related", "absent", DAY[1])])
    got = sync.merge_links(mine, local, theirs, remote)
    assert {(r.from_id, r.to_id, r.rel_type, r.note) for r in got.collect()} == {("l/a", "l/b", "related", "new"), ("l/b", "l/a", "related", "mine"), ("l/a", "l/b", "supports", "more")}
    plan = by(sync.named_link_plan(mine, local, theirs, remote).filter("rel_type = 'related'"), "to_path", "action")
    assert plan["/b"] == "pull" and plan["/a"] == "push"


def test_sync_of_the_journal(spark):
    row = lambda **k: k
    local = {
        "projects": table(spark, "projects", [row(id=1, name="p", status="old", updated_at=DAY[0], created_at=DAY[0]), row(id=2, name="mine", updated_at=DAY[0])]),
        "milestones": table(spark, "milestones", [row(id=5, project_id=1, title="m", sync_id="m1", updated_at=DAY[4])]),
        "tasks": table(spark, "tasks", [row(id=9, milestone_id=5, title="t", sync_id="t1", updated_at=DAY[0])]),
        "logs": table(spark, "logs", []),
    }
    remote = {
        "projects": table(spark, "projects", [row(id=40, name="p", status="new", updated_at=DAY[2], created_at=DAY[9]), row(id=41, name="theirs", updated_at=DAY[0], deleted_at=DAY[0])]),
        "milestones": table(spark, "milestones", [row(id=50, project_id=40, title="older", sync_id="m1", updated_at=DAY[1]), row(id=51, project_id=41, title="m2", sync_id="m2", updated_at=DAY[1], deleted_at=DAY[1]), row(id=52, project_id=99, title="lost", sync_id="m3", updated_at=DAY[1])]),
        "tasks": table(spark, "tasks", [row(id=90, milestone_id=50, title="t new", sync_id="t1", updated_at=DAY[3]), row(id=91, milestone_id=51, title="t2", sync_id="t2", updated_at=DAY[1])]),
        "logs": table(spark, "logs", [row(id=7, project_id=40, entry="e", sync_id="g1", updated_at=DAY[0])]),
    }
    got = sync.sync_journal(local, remote)
    p = {r.name: r for r in got["projects"].collect()}
    assert (p["p"].id, p["p"].status, p["p"].created_at) == (1, "new", DAY[0]) and p["theirs"].id == 3 and p["mine"].id == 2
    m = {r.sync_id: r for r in got["milestones"].collect()}
    assert set(m) == {"m1", "m2"} and (m["m1"].id, m["m1"].title) == (5, "m") and (m["m2"].id, m["m2"].project_id, m["m2"].deleted_at) == (6, 3, DAY[1])
    t = {r.sync_id: r for r in got["tasks"].collect()}
    assert (t["t1"].id, t["t1"].title, t["t1"].milestone_id) == (9, "t new", 5) and t["t2"].milestone_id == 6
    assert got["logs"].first().project_id == 1
    kept = sync.incoming(table(spark, "memory_nodes", [node("/a", type="odd", title="x" * 900), node("no/root")]), "/links/peer").collect()
    assert [(r.path, r.type, len(r.title)) for r in kept] == [("/links/peer/a", "note", 500)]


def test_journal_writes_and_reads(spark):
    p = table(spark, "projects", [{"id": 1, "name": "p"}, {"id": 2, "name": "z", "archived": True}])
    m = journal.append(table(spark, "milestones", []), spark.createDataFrame([(1, "a"), (1, "b")], "project_id int, title string"), NOW)
    m = session.materialize(m)
    assert [(r.id, r.title, r.created_at) for r in m.orderBy("id").collect()] == [(1, "a", AT), (2, "b", AT)] and m.select("sync_id").distinct().count() == 2
    done = journal.complete(m, spark.createDataFrame([(2,)], "id int"), True, NOW)
    assert by(done, "id", "completed", "completed_at") == {1: (None, None), 2: (True, AT)}
    assert by(journal.edit(done, spark.createDataFrame([(1, "c"), (9, "x")], "id int, title string"), NOW), "id", "title") == {1: "c", 2: "b"}
    r = table(spark, "reminders", [{"id": 1, "project_id": 1, "target_date": "2026-01-10"}, {"id": 2, "project_id": 1, "target_date": "2026-01-09 08:00"}, {"id": 3, "project_id": 1, "target_date": "2027-01-01"}, {"id": 4, "project_id": 1, "target_date": "2025-01-01", "completed": True}, {"id": 5, "project_id": 1, "target_date": "soon"}])
    got = journal.overview(p, done, r, NOW).collect()
    assert [(x.project, x.done_pct, x.open, x.due, x.overdue) for x in got] == [("p", 50.0, 4, 2, 1)] and journal.overview(p, done, r, NOW, archived=True).count() == 2
    e = table(spark, "errors_solutions", [{"id": 1, "project_id": 1, "error_msg": "Disk full", "solution_msg": "clean", "created_at": DAY[0]}, {"id": 2, "project_id": 1, "error_msg": "other", "created_at": DAY[1]}])
    assert [x.id for x in journal.errors_of(p, e, "p").collect()] == [2, 1] and [x.id for x in journal.errors_of(p, e, words=["disk", "clean"]).collect()] == [1]
    w = table(spark, "wiki_pages", [{"id": 1, "project_id": 1, "title": "B", "content": "Deploy steps"}, {"id": 2, "project_id": 1, "title": "A"}, {"id": 3, "project_id": 2, "title": "A"}])
    pages = lambda **k: [x.id for x in journal.search_pages(p, w, "p", **k).collect()]
    assert pages() == [2, 1] and pages(words=["deploy"]) == [1] and pages(title="A") == [2]
    more = journal.ensure_projects(p, spark.createDataFrame([("p",), (" new ",), (None,), ("new",)], "name string"), NOW)
    assert sorted((x.id, x.name) for x in more.collect()) == [(1, "p"), (2, "z"), (3, "new")]
    g = table(spark, "logs", [{"id": i, "project_id": 1, "logged_at": DAY[i], "entry": str(i)} for i in range(25)])
    view = journal.project_view("p", p, m, table(spark, "tasks", []), g, 3).filter("kind = 'log'").orderBy("position").collect()
    assert [x.title for x in view] == ["22", "23", "24"]


@pytest.mark.parametrize("spans", [4, 256])
def test_newest_lines_within_bytes(spark, spans):
    rows = [(i // 2 * 2, "x" * (i % 13)) for i in range(3000)]
    df = spark.createDataFrame(rows, "at long, line string")
    for budget in (0, 5, 777, 12345, 10**9):
        used, want = 0, 0
        for at in sorted({r[0] for r in rows}, reverse=True):
            size = sum(len(x) + 1 for a, x in rows if a == at)
            if used + size > budget:
                break
            used, want = used + size, want + 2
        assert stats.tail_bytes(df, "at", "line", budget, spans).count() == want


def test_event_log_is_compacted(spark, tmp_path):
    log = f"{tmp_path}/log"
    make = lambda a, b: spark.createDataFrame([(float(i), "prompt", "x" * 50) for i in range(a, b)], "ts double, event string, reason string")
    files.append_events(make(0, 200), log)
    files.append_events(make(200, 210), log, most=5000)
    got = sorted(r.ts for r in files.read_events(spark, log).collect())
    assert got[-10:] == [float(i) for i in range(200, 210)] and got[0] > 150 and got == [float(i) for i in range(int(got[0]), 210)]
    assert not files.compact_events(spark, log, 10**9)


def test_markdown_files_and_folders(spark, tmp_path):
    out = f"{tmp_path}/tree"
    n = table(spark, "memory_nodes", [node("/projects/p/a", title="A", body="Body ä"), node("/notes/b", title="B"), node("/notes/../../c")])
    assert files.export_markdown(n, out) == 2 and (tmp_path / "tree/projects/p/a.md").read_text().endswith("Body ä\n")
    assert files.export_markdown(n.filter("path = '/notes/b'"), out) == 1
    assert [x.name for x in (tmp_path / "tree").rglob("*.md")] == ["b.md"]
    folders = spark.createDataFrame([("pp", str(tmp_path / "tree" / "notes")), ("other", "/elsewhere")], "project string, dir string")
    got = files.read_memory_files(spark, f"{out}/notes", folders).first()
    assert (got.path, got.title, got.body) == ("/projects/pp/b", "B", "")
    told = stats.file_coverage(spark.createDataFrame([("f1", "---\nname: x\n---\nSome  Text here"), ("f2", "nothing")], "path string, text string"), table(spark, "memory_nodes", [node("/n", body="some text here")])).first()
    assert (told["files"], told.covered) == (2, 1)


def test_injections_and_their_use(spark, tmp_path):
    said = lambda text: {"type": "assistant", "message": {"content": [{"type": "text", "text": text}, {"type": "tool_use", "input": {"q": "violin"}}]}}
    asked = lambda text, **k: {"type": "user", "message": {"content": text}} | k
    note = lambda *paths: {"type": "attachment", "timestamp": "2026-01-05T10:00:00", "attachment": {"type": "hook_additional_context", "content": ["# memories", *[f"x ⟨{p}⟩" for p in paths]]}}
    lines = [said("before"), asked("first question"), note("/a", "/b"), said("quartz lattice"), asked("meta", isMeta=True), said("more"), asked("second"), said("unrelated"), note("/c"), asked([{"type": "tool_result"}]), said("see /c now"), {"type": "attachment", "attachment": {"type": "other", "content": "# memories ⟨/z⟩"}}]
    (tmp_path / "t.jsonl").write_text("not json\n\n" + "\n".join(json.dumps(x) for x in lines))
    got = files.read_injections(spark, str(tmp_path)).orderBy("turn").collect()
    assert [(r.paths, r.prompt, r.reply) for r in got] == [(["/a", "/b"], "first question", 'quartz lattice\n{"q":"violin"}\nmore\n{"q":"violin"}'), (["/c"], "second", 'see /c now\n{"q":"violin"}')]
    assert got[0].injected_at == datetime(2026, 1, 5, 10)
    corpus = spark.createDataFrame([("/a", "", "quartz lattice crystal"), ("/b", "", "river delta"), ("/c", "", "sediment"), ("/d", "", "violin")], "path string, title string, body string")
    judged = by(files.feedback(files.read_injections(spark, str(tmp_path)), corpus), "path", "used", "score")
    assert judged["/a"][0] and not judged["/b"][0] and judged["/c"] == (True, 0.0)
    prompts = files.mine_prompts(spark.createDataFrame([("c", 1, "user", "how does it work", DAY[0]), ("c", 2, "user", "how does it work", DAY[1]), ("c", 3, "user", "/clear everything", DAY[1]), ("c", 4, "assistant", "an answer to it", DAY[1])], "conv string, turn int, role string, text string, modified timestamp_ntz"))
    assert [r.prompt for r in prompts.collect()] == ["how does it work"]


def test_queue_makes_projects_and_keeps_to_retention(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("p", "error", "w", "boom", "2026-01-09 10:00:00"), ("fresh", None, "w", "hello", "2026-01-09 10:00:00"), ("p", "info", "w", "too old", "2020-01-01 00:00:00")]
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("project", "level", "worker", "message", "timestamp"), r, strict=True))) for r in rows))
    projects = table(spark, "projects", [{"id": 1, "name": "p", "config": '{"log_retention_days": 30}'}])
    jobs.ingest_queue(jobs.read_folder(spark, str(tmp_path / "in"), jobs.QUEUE), str(tmp_path / "out"), str(tmp_path / "cp"), projects=projects, clock=NOW).awaitTermination()
    assert sorted((r.project_id, r.entry) for r in spark.read.parquet(f"{tmp_path}/out/logs").collect()) == [(1, "boom"), (2, "hello")]
    assert by(spark.read.parquet(f"{tmp_path}/out/projects"), "name", "id") == {"p": 1, "fresh": 2} and spark.read.parquet(f"{tmp_path}/out/errors").count() == 1
    assert jobs.since(projects, "updated_at", None).count() == 1 and jobs.since(projects, "updated_at", NOW).count() == 0


def test_new_nodes_are_linked_as_they_come(spark, tmp_path):
    v = {"/a": [1.0, 0.0], "/b": [1.0, 0.01], "/c": [0.0, 1.0], "/d": [0.01, 1.0], "/e": [-1.0, 0.3]}
    n = spark.createDataFrame([(p, p, "", "see /notes/x" if p == "/a" else "", x) for p, x in v.items()] + [("/notes/x", "/notes/x", "", "", None)], "id string, path string, title string, body string, embedding array<float>")
    named = spark.createDataFrame([], "from_path string, to_path string, rel_type string, link_origin string, confidence float")
    spark.createDataFrame([("/a",)], "path string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string").parquet(f"{tmp_path}/in")
    jobs.link_new_nodes(stream, lambda: (n, named), f"{tmp_path}/out", f"{tmp_path}/cp", dims=2).awaitTermination()
    got = {(r.a, r.b): r.action for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["/a", "/b"] == "link" and got["/a", "/notes/x"] == "link" and all("/a" in k for k in got)
    ranked = {(r.a, r.b): r["rank"] for r in jobs.focus_links(spark.createDataFrame([("/a",)], "path string"), n, named, 2).collect()}
    assert ranked["/a", "/b"] == 1 and ranked["/a", "/d"] == 2 and ranked["/a", "/notes/x"] is None


def test_late_events_and_watermarks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    event = lambda t, v: json.dumps({"ts": t, "event_type": "click", "value": v})
    read = lambda: jobs.read_folder(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double")
    drain = lambda: jobs.run(jobs.rollup_windows(read()), lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}"), str(tmp_path / "cp")).awaitTermination()
    for i, lines in enumerate([[event("2026-01-01 10:10:00", 1), event("2026-01-01 15:00:00", 1)], [event("2026-01-01 10:20:00", 5), event("2026-01-01 15:10:00", 1)], [event("2026-01-02 10:00:00", 1)]]):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines))
        drain()
    got = {r.start.hour: (r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {10: (1, 1.0), 15: (2, 2.0)}  # the late event of ten o'clock is left out


def test_written_tables_are_released(spark):
    import os

    df = session.materialize(spark.range(3))
    path = session._WRITTEN[-1].removeprefix("file://")
    kept, session._WRITTEN[:] = session._WRITTEN[:-1], session._WRITTEN[-1:]
    assert df.count() == 3 and os.path.isdir(path)
    session.release(spark)
    assert not os.path.exists(path) and not session._WRITTEN
    session._WRITTEN[:] = kept


def test_queries_are_listed_without_a_session():
    """The driver may read the list before there is a session: nothing builds a column while modules load."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
