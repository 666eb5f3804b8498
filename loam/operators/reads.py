"""Composed reads: a search with what belongs beside its hits, a node with its links, a subgraph for a question, and what a session begins with.

Each is one table of rows of several kinds, for any number of queries, paths or projects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import paths as ps
from loam.functions import text as tx
from loam.functions.vector import centroid, cosine, usable_vector
from loam.operators import gate, graph, stats
from loam.operators import retrieval as rt
from loam.session import lookup_join, materialize
from loam.visibility import importance, moment


def _null() -> Column:
    return F.lit(None).cast("string")


def _rows(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), *[c.alias(name) for name, c in columns.items()])


def search(shown: DataFrame, extracted: DataFrame, links: DataFrame, queries: DataFrame, now: str, limit: int = 20) -> DataFrame:
    """(kind, query, position, path, other, score): `hit`s of the hybrid search; `contradiction`s of hits with another node; `tripwire`, the
    extracted tier's few nearly equal nodes; `hidden`, the number (in score) of extracted nodes with all words of the query or its text."""
    hits = materialize(rt.hybrid(shown, queries, now, limit, dims=rt.DIMS))
    against = rt.contradictions(hits.select("query", "path"), shown, links)
    trip = rt.tripwire(extracted, queries, dims=rt.DIMS)
    trip = trip.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "path")))
    more = rt.match_counts(extracted, queries)
    no = F.lit(None).cast("long")
    parts = [
        _rows(hits, "hit", query=F.col("query"), position=F.col("position").cast("long"), path=F.col("path"), other=_null(), score=F.round("retrieval_score", 9)),
        _rows(against, "contradiction", query=F.col("query"), position=no, path=F.col("path"), other=F.col("neighbour"), score=F.lit(None).cast("double")),
        _rows(trip, "tripwire", query=F.col("query"), position=F.col("position").cast("long"), path=F.col("path"), other=_null(), score=F.col("sim")),
        _rows(more, "hidden", query=F.col("query"), position=no, path=_null(), other=_null(), score=F.col("n").cast("double")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def plain_search(nodes: DataFrame, queries: DataFrame, k: int = 30) -> DataFrame:
    """(query, path, position): nodes with every word of the query by lexical score; where there is none, those that contain its text, by path."""
    lexical = materialize(rt.lexical_arm(nodes, queries, k))
    rest = queries.select(F.col("query").cast("string"), "text").join(lexical.select("query").distinct(), "query", "left_anti")
    both = lexical.unionByName(rt.substring_arm(nodes, rest, k).withColumn("score", F.lit(0.0)))
    return rt.top(both, ["query"], [F.desc("score"), F.col("path")], k, "position").select("query", "path", "position")


def read_nodes(nodes: DataFrame, links: DataFrame, paths: DataFrame, now: str) -> DataFrame:
    """(path, kind, rel_type, other, expired) of live nodes (path): a `node` row with whether it has expired; `out` and `in` for its links to live nodes; `contradicts` for what it contradicts either way."""
    live = nodes.filter("deleted_at is null")
    mine = live.join(paths.select("path").distinct(), "path", "left_semi").select("path", "id", "valid_until")
    gone = F.coalesce(F.col("valid_until") < moment(now), F.lit(False))
    other = live.select(F.col("id").alias("other_id"), F.col("path").alias("other"))
    linked = rt.directed(links).withColumnRenamed("other", "other_id").join(mine.select("path", "id"), "id").join(other, "other_id")
    none = F.lit(None).cast("boolean")
    rows = mine.select("path", F.lit("node").alias("kind"), _null().alias("rel_type"), _null().alias("other"), gone.alias("expired"))
    rows = rows.unionByName(linked.select("path", F.col("direction").alias("kind"), "rel_type", "other", none.alias("expired")))
    return rows.unionByName(linked.filter("rel_type = 'contradicts'").select("path", F.lit("contradicts").alias("kind"), "rel_type", "other", none.alias("expired")).distinct())


def graph_query(nodes: DataFrame, links: DataFrame, queries: DataFrame, now: str, k: int = 5) -> DataFrame:
    """(query, position, path, direction, rel_type, neighbour, tag): the k best nodes by re-ranked similarity out of max(3 k, 15), each with its links to live nodes and whether a link is EXPLICIT or INFERRED; a hit without links comes once, with nulls."""
    live = nodes.filter("deleted_at is null")
    curated = live.filter("origin = 'curated'")
    near = rt.vector_arm(curated, queries, max(3 * k, 15), rt.DIMS).join(curated.select("path", "id", "importance", "updated_at"), "path")
    hits = rt.top(rt.rerank(near, "sim", now), ["query"], [F.desc("final_score"), F.col("path")], k, "position").select("query", "path", "id", F.col("position").cast("long").alias("position"))
    ends = links.select(F.col("from_id").alias("id"), F.col("to_id").alias("o"), F.lit("out").alias("direction"), "rel_type", "link_origin").unionByName(links.select(F.col("to_id").alias("id"), F.col("from_id").alias("o"), F.lit("in").alias("direction"), "rel_type", "link_origin"))
    named = ends.join(live.select(F.col("id").alias("o"), F.col("path").alias("neighbour")), "o").select("id", "direction", "rel_type", "neighbour", F.when(F.col("link_origin") == "explicit", "EXPLICIT").otherwise("INFERRED").alias("tag"))
    return hits.join(named, "id", "left").drop("id")


#: Characters of a pinned body, least importance and number of global rules, share of the rest that the index may take.
PIN_CHARS, RULE_IMPORTANCE, RULES, INDEX_SHARE = 1500, 0.7, 20, 0.7


def session_digest(shown: DataFrame, projects: DataFrame, now: str, trigger: str = "start", budget: int = 8000) -> DataFrame:
    """(project, section, position, path, n) for each project asked for: its `pin`s, its `index` by rank score, `rule`s that hold everywhere, and the number n of lines `omitted`.

    A section ends before its first line that doesn't fit: pins within the budget, the index within INDEX_SHARE of what they
    leave, rules within the rest. Rules are the RULES best of /user/ and /feedback/ by importance, accesses and similarity to the
    project's mean vector. shown: live, curated, fresh nodes without categories; projects: (project)."""
    asked = materialize(projects.select("project").distinct())
    n_asked = asked.count()
    triggers = F.array(*[F.lit(t) for t in (["start", "compact"] if trigger == "compact" else ["start"])])
    hook = tx.first_sentence(F.col("body"))
    size = lambda *parts: (F.length(F.concat_ws(" ", *parts)) + 1).cast("long")
    mine = lookup_join(shown.withColumn("project", ps.project_slug(F.col("path"))).filter("project is not null"), asked, "project", rows=n_asked)
    pinned = F.coalesce(F.arrays_overlap("pin_triggers", triggers), F.lit(False))
    accesses = F.least(F.coalesce("access_count", F.lit(0)), F.lit(20))
    score = importance() + accesses / 40.0 + F.when(F.col("updated_at") >= moment(now) - F.expr("INTERVAL 30 DAYS"), 0.2).otherwise(0.0)
    lines = mine.select("project", "path", F.when(pinned, "pin").otherwise("index").alias("section"), F.round(F.when(pinned, importance()).otherwise(score), 9).alias("score"), F.when(pinned, size("title", "path", F.substring("body", 1, PIN_CHARS))).otherwise(size("path", "title", hook)).alias("chars"))
    centre = centroid(mine.filter(usable_vector(F.col("embedding"), rt.DIMS)), ["project"], "embedding")
    rules = shown.filter((F.col("path").startswith("/user/") | F.col("path").startswith("/feedback/")) & (F.round(F.col("importance").cast("double"), 6) >= RULE_IMPORTANCE))
    near = F.when(F.col("centroid").isNotNull() & F.col("embedding").isNotNull(), 0.8 * cosine("embedding", "centroid")).otherwise(0.0)
    each = asked.join(centre, "project", "left")
    each = rules.join(F.broadcast(each)) if n_asked <= 1000 else rules.join(each)  # every rule is weighed for every project asked for
    each = each.select("project", "path", F.lit("rule").alias("section"), F.round(importance() + accesses / 100.0 + near, 9).alias("score"), size("title", hook, "path").alias("chars"))
    lines = lines.unionByName(rt.top(each, ["project"], [F.desc("score"), F.col("path")], RULES))
    w = Window.partitionBy("project", "section").orderBy(F.desc("score"), "path")
    lines = lines.withColumns({"position": F.row_number().over(w).cast("long"), "run": F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    lines = materialize(lines.select("project", "section", "position", "path", "run"))

    def used(section: str, room: Column, before: DataFrame) -> DataFrame:
        fits = lines.filter(F.col("section") == section).join(before, "project").filter(F.col("run") <= room).groupBy("project").agg(F.max("run").alias(f"u_{section}"))
        return before.join(fits, "project", "left").fillna(0, [f"u_{section}"])

    room = {"pin": F.lit(budget), "index": F.floor((F.lit(budget) - F.col("u_pin")) * INDEX_SHARE), "rule": F.lit(budget) - F.col("u_pin") - F.col("u_index")}
    at = used("index", room["index"], used("pin", room["pin"], asked))
    limit = F.when(F.col("section") == "pin", room["pin"]).when(F.col("section") == "index", room["index"]).otherwise(room["rule"])
    told = lines.join(at, "project").withColumn("fits", F.col("run") <= limit)
    kept = told.filter("fits").select("project", "section", "position", "path", F.lit(None).cast("long").alias("n"))
    omitted = told.filter("not fits and section != 'pin'").groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("project", F.lit("omitted").alias("section"), F.lit(None).cast("long").alias("position"), _null().alias("path"), "n")
    return kept.unionByName(omitted)


def session_pins(shown: DataFrame, trigger: str = "start") -> DataFrame:
    """(project, position, path, title): what a session of each project is told in full."""
    wanted = F.array(*[F.lit(t) for t in (["start", "compact"] if trigger == "compact" else ["start"])])
    rows = shown.withColumn("project", ps.project_slug(F.col("path"))).filter("project is not null").filter(F.arrays_overlap("pin_triggers", wanted))
    order = Window.partitionBy("project").orderBy(F.desc(importance()), "path")
    return rows.select("project", F.row_number().over(order).cast("long").alias("position"), "path", "title")


def context(nodes: DataFrame, now: str, recent: int = 15) -> DataFrame:
    """(kind, name, n, at): `branch`es of live curated nodes, the `recent` ones changed last, and the number of `extracted` nodes."""
    live = nodes.filter("deleted_at is null")
    curated = live.filter("origin = 'curated' and type != 'category'")
    last = curated.filter(~F.contains("path", F.lit("/auto/"))).orderBy(F.desc("updated_at"), "path").limit(recent)
    rows = stats.branches(curated).select(F.lit("branch").alias("kind"), F.col("branch").alias("name"), "n", F.col("last_update").alias("at"))
    rows = rows.unionByName(last.select(F.lit("recent").alias("kind"), F.col("path").alias("name"), F.lit(None).cast("long").alias("n"), F.col("updated_at").alias("at")))
    return rows.unionByName(live.filter("origin = 'extracted'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("extracted").alias("kind"), _null().alias("name"), "n", F.lit(None).cast("timestamp_ntz").alias("at")))


def graph_report(nodes: DataFrame, links: DataFrame, most: int = 8) -> DataFrame:
    """(kind, a, b, n): totals of `nodes`, `links`, `clusters` and `orphans`; the `hub`s; the `cluster`s of at least two nodes by their first path; each `orphan` that is no category; each `contradiction`."""
    sub = materialize(graph.subgraph(nodes, links))
    degree = materialize(graph.degrees(nodes, sub).join(nodes.select("path", "type"), "path"))
    found = materialize(graph.node_components(nodes, sub).groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2"))
    alone = degree.filter("degree = 0 and (type is null or type != 'category')")
    row = lambda df, kind, a=None, b=None, n=None: df.select(F.lit(kind).alias("kind"), (_null() if a is None else a).alias("a"), (_null() if b is None else b).alias("b"), (F.lit(None).cast("long") if n is None else n).alias("n"))
    count = lambda df, kind: row(df.agg(F.count(F.lit(1)).alias("n")), kind, n=F.col("n"))
    against = graph.named_links(nodes, sub.filter("rel_type = 'contradicts'"))
    parts = [count(nodes, "nodes"), count(sub, "links"), count(found, "clusters"), count(alone, "orphans")]
    parts += [row(degree.filter("degree > 0").orderBy(F.desc("degree"), "path").limit(most), "hub", F.col("path"), n=F.col("degree")), row(found, "cluster", F.col("component"), n=F.col("n")), row(alone, "orphan", F.col("path")), row(against, "contradiction", F.col("from_path"), F.col("to_path")).distinct()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def retrieve(lexical: DataFrame, semantic: DataFrame, nodes: DataFrame, suppressed: DataFrame, told: DataFrame | None = None, model: gate.GateModel = gate.GateModel(), p: gate.GateParams = gate.GateParams()) -> DataFrame:
    """(query, path, confidence, position): what the learned gate lets through, of both signals' candidates without suppressed paths and those told before. A signal may bring the nodes' importance."""
    known = nodes.select("path", "importance")
    lexical, semantic = [df if "importance" in df.columns else df.join(known, "path") for df in (lexical, semantic)]
    merged = gate.without(gate.merge_signals(lexical, semantic, ["importance"]), suppressed, told)
    slug = ps.project_slug
    rows = merged.withColumn("importance", importance()).withColumn("in_project", F.coalesce(slug(F.col("query")) == slug(F.col("path")), F.lit(False)))
    scored = gate.learned_confidence(gate.add_features(rows.select("query", "path", "lex_conf", "sim", "importance", "in_project")), model)
    return gate.select_hits(scored, model.min_prob, p).select("query", "path", "confidence", "position")
