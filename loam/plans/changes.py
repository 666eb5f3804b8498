"""Queries of changes and decisions: the state they leave, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam import schemas
from loam.operators import consolidate, decisions, journal, linking, mutate
from loam.operators.references import Reference, orphans
from loam.plans import linkage
from loam.plans.common import LINKS, LIVE, NOW, SHOWN, T, Registry, links, nodes, shown
from loam.plans.linkage import _cur, _j
from loam.session import materialize, read_table
from loam.visibility import visible

R = Registry()
_NAMES = "('oskxill', 'quirisk')"
_NAME = f"(SELECT name FROM projects WHERE {LIVE} ORDER BY id LIMIT 1)"
_PID = f"(SELECT id FROM projects WHERE {LIVE} ORDER BY id LIMIT 1)"


def _first_project(j: dict[str, DataFrame]) -> str:
    row = j["projects"].filter("deleted_at is null").orderBy("id").first()
    return row["name"] if row else ""


@R.add("project_view", f"""SELECT 'project' AS kind, CAST(id AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, name AS title, CAST(NULL AS BOOLEAN) AS done, updated_at AS at, CAST(NULL AS BIGINT) AS position FROM {_cur('projects')} WHERE id = {_PID}
UNION ALL SELECT 'milestone', id, project_id, title, coalesce(completed, false), completed_at, NULL FROM {_cur('milestones')} WHERE project_id = {_PID}
UNION ALL SELECT 'task', id, milestone_id, title, coalesce(completed, false), created_at, NULL FROM {_cur('tasks')} WHERE milestone_id IN (SELECT id FROM {_cur('milestones')} WHERE project_id = {_PID})
UNION ALL SELECT 'log', id, project_id, entry, NULL, logged_at, row_number() OVER (ORDER BY logged_at, id) FROM (SELECT * FROM {_cur('logs')} WHERE project_id = {_PID} ORDER BY logged_at DESC NULLS LAST, id DESC LIMIT 20)""")
def _(s, d):
    j = _j(s, d)
    return journal.project_view(_first_project(j), **j)


_REMIND = f"(SELECT *, strftime(created_at, '%Y-%m-%d') AS target_date FROM {_cur('milestones')})"


@R.add("project_overview", f"""SELECT p.name AS project, coalesce(p.archived, false) AS archived, CASE WHEN m.n > 0 THEN round_even(100.0 * m.done / m.n, 1) ELSE 0.0 END AS done_pct, p.updated_at, coalesce(r.o, 0) AS open, coalesce(r.due, 0) AS due, coalesce(r.late, 0) AS overdue
FROM {_cur('projects')} p LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (completed) AS done FROM {_cur('milestones')} GROUP BY 1) m ON m.project_id = p.id LEFT JOIN (SELECT project_id, count(*) FILTER (NOT coalesce(completed, false)) AS o, count(*) FILTER (NOT coalesce(completed, false) AND target_date <= '{NOW[:10]}') AS due, count(*) FILTER (NOT coalesce(completed, false) AND target_date < '{NOW[:10]}') AS late FROM {_REMIND} GROUP BY 1) r ON r.project_id = p.id""")
def _(s, d):
    """Milestones stand for reminders, due on the day they were made: there is no table of reminders here."""
    j = _j(s, d)
    reminders = j["milestones"].withColumn("target_date", F.date_format("created_at", "yyyy-MM-dd"))
    return journal.overview(j["projects"], j["milestones"], reminders, NOW, archived=True)


@R.add("ensure_ancestors", f"""WITH n AS (SELECT * FROM memory_nodes WHERE type <> 'category'), a AS (SELECT DISTINCT path FROM (SELECT unnest(list_transform(range(2, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path FROM n WHERE {LIVE}))
SELECT n.path, n.type, CASE WHEN a.path IS NULL THEN n.deleted_at END AS deleted_at FROM n LEFT JOIN a ON a.path = n.path UNION ALL SELECT path, 'category', NULL FROM a WHERE path NOT IN (SELECT path FROM n)""")
def _(s, d):
    """With the categories left out, so that something is missing."""
    return mutate.ensure_ancestors(nodes(s, d).filter("type != 'category'"), NOW).select("path", "type", "deleted_at")


@R.add("save_extracted", f"""SELECT coalesce(n.path, r.path) AS path, CASE WHEN r.path IS NOT NULL THEN 'extracted' ELSE n.origin END AS origin, CASE WHEN r.path IS NOT NULL THEN r.title ELSE n.title END AS title, CASE WHEN r.path IS NOT NULL THEN {T} + INTERVAL 90 DAYS ELSE n.valid_until END AS valid_until, CASE WHEN n.path IS NULL THEN {T} ELSE n.created_at END AS created_at
FROM memory_nodes n FULL JOIN (SELECT path, any_value(title) AS title FROM memory_nodes_remote WHERE origin = 'extracted' AND path NOT IN (SELECT path FROM memory_nodes WHERE origin = 'curated' AND {LIVE}) GROUP BY 1 HAVING count(*) = 1) r ON r.path = n.path""")
def _(s, d):
    """The extracted nodes of the other system, where they come once, saved into this one."""
    remote = read_table(s, d, "memory_nodes_remote").filter("origin = 'extracted'")
    once = remote.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("title").alias("title"), F.max("body").alias("body")).filter("n = 1")
    return mutate.save_extracted(nodes(s, d), once, NOW).select("path", "origin", "title", "valid_until", "created_at")


@R.add("delete_projects", f"""WITH p AS (SELECT DISTINCT id FROM projects WHERE deleted_at IS NOT NULL OR name = {_NAME}), m AS (SELECT DISTINCT id, deleted_at IS NOT NULL OR project_id IN (SELECT id FROM p) AS gone FROM milestones)
SELECT 'projects' AS kind, count(*) AS n FROM p UNION ALL SELECT 'milestones', count(DISTINCT id) FROM m WHERE gone UNION ALL SELECT 'tasks', count(DISTINCT id) FROM tasks WHERE deleted_at IS NOT NULL OR milestone_id IN (SELECT id FROM m WHERE gone)""")
def _(s, d):
    """How many rows of each table are tombstoned after a project is deleted."""
    j = _j(s, d)
    after = mutate.delete_projects(j["projects"], j["milestones"], j["tasks"], [_first_project(j)], NOW)
    count = lambda df, kind: df.filter("deleted_at is not null").select(F.countDistinct("id").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(after[0], "projects").unionByName(count(after[1], "milestones")).unionByName(count(after[2], "tasks"))


_PAIR = f"(SELECT DISTINCT b.path AS old FROM {LINKS} l JOIN memory_nodes a ON a.id = l.from_id JOIN memory_nodes b ON b.id = l.to_id WHERE l.rel_type = 'supersedes' AND a.path <> b.path AND a.deleted_at IS NULL AND b.deleted_at IS NULL)"


@R.add("supersede", f"SELECT n.path, CASE WHEN o.old IS NOT NULL THEN {T} ELSE n.valid_until END AS valid_until FROM memory_nodes n LEFT JOIN {_PAIR} o ON o.old = n.path")
def _(s, d):
    """What the links say supersedes something, superseded again."""
    n, l = nodes(s, d), links(s, d)  # noqa: E741
    named = [n.select(F.col("id").alias(f"{x}_id"), F.col("path").alias(name)) for x, name in (("from", "new"), ("to", "old"))]
    pairs = l.filter("rel_type = 'supersedes'").join(named[0], "from_id").join(named[1], "to_id").select("new", "old").distinct()
    return decisions.supersede(n, l, pairs, NOW)[0].select("path", "valid_until")


_OLD = f"(valid_until < {T} - INTERVAL 14 DAYS)"
_STALE = f"(type <> 'category' AND round(CAST(importance AS DOUBLE), 6) <= 0.4 AND len(coalesce(pin_triggers, [])) = 0 AND valid_until IS NULL AND updated_at < {T} - INTERVAL 180 DAYS)"


@R.add("decide_proposals", f"SELECT path, CASE WHEN {LIVE} AND origin = 'curated' AND {_OLD} THEN {T} ELSE deleted_at END AS deleted_at, CASE WHEN {LIVE} AND origin = 'curated' AND {_STALE} THEN {T} ELSE valid_until END AS valid_until FROM memory_nodes")
def _(s, d):
    """All expired nodes deleted and all stale ones archived, by way of the queue."""
    n = nodes(s, d)
    kept = n.filter(visible(NOW, include_expired=True))
    found = consolidate.expired(kept, NOW).select(F.lit("expired").alias("kind"), F.array("path").alias("paths"), F.date_format("valid_until", "yyyy-MM-dd").alias("extra"))
    found = found.unionByName(consolidate.stale(kept.filter("type != 'category'"), NOW).select(F.lit("stale").alias("kind"), F.array("path").alias("paths"), F.date_format("updated_at", "yyyy-MM-dd").alias("extra")))
    found = found.withColumn("fingerprint", consolidate.fingerprint(F.col("kind"), F.col("paths"), F.col("extra")))
    queue = materialize(decisions.stamped(found, n, NOW))
    told = queue.select("fingerprint", F.when(F.col("kind") == "expired", "delete").otherwise("archive").alias("decision"))
    return decisions.decide(queue, n, links(s, d), told, NOW)[1].select("path", "deleted_at", "valid_until")


def _routed(s, d) -> DataFrame:
    scored, named, vectors, mentioned = linkage._scored(s, d)
    scored = materialize(scored)
    routed = linking.route(scored, named, linkage._decided(named))
    return materialize(routed.join(linking.evidence(scored, vectors, mentioned), ["a", "b"]))


_ROUTED = linkage.ORACLE["link_routing"]
_SIDE = f"(SELECT id, path FROM {SHOWN})"


@R.add("pending_links", f"SELECT least(x.id, y.id) AS from_id, CASE WHEN x.id < y.id THEN a ELSE b END AS a_path, CASE WHEN x.id < y.id THEN b ELSE a END AS b_path, round(CAST(CAST(confidence AS FLOAT) AS DOUBLE), 6) AS confidence, count(*) OVER () AS total FROM ({_ROUTED}) r JOIN {_SIDE} x ON x.path = r.a JOIN {_SIDE} y ON y.path = r.b WHERE action = 'suggest'")
def _(s, d):
    """What a run suggests, as a reviewer sees it."""
    ids = shown(s, d).select("path", "id")
    queue = decisions.suggest(schemas.empty(s, "link_suggestions"), _routed(s, d).filter("action = 'suggest'"), ids, NOW)
    rows = decisions.pending_links(queue, nodes(s, d))
    by_id = ids.withColumnsRenamed({"path": "a_path", "id": "from_id"})
    return rows.join(by_id, "a_path").select("from_id", "a_path", "b_path", F.round(F.col("confidence").cast("double"), 6).alias("confidence"), "total")


@R.add("link_run", f"SELECT action, count(*) AS n FROM ({_ROUTED}) GROUP BY 1")
def _(s, d):
    """The whole run, as its summary counts it."""
    return _routed(s, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# composite references: the pairs (project, lang) of documents, against those that the early ones have

_EARLY = "2025-06-01 00:00:00"
_DOCS = "(SELECT CAST(doc_id AS VARCHAR) AS id, project AS a, lang AS b, created_at AS c FROM documents)"
_ROSTER = f"(SELECT project AS x, lang AS y, min(created_at) AS tc FROM documents WHERE created_at < TIMESTAMP '{_EARLY}' GROUP BY 1, 2)"


def _match(name: str, condition: str, keys: str) -> str:
    first = f"(SELECT min(tc) FROM {_ROSTER} t WHERE {keys})"
    return f"SELECT '{name}' AS match, id AS ref_id, CASE WHEN {first} IS NULL THEN 'missing' ELSE 'late' END AS kind FROM {_DOCS} r WHERE {condition} AND ({first} IS NULL OR {first} > r.c)"


_BOTH, _X, _Y = "r.a IS NOT NULL AND r.b IS NOT NULL", "t.x = r.a", "t.y = r.b"


@R.add("p4_composite", " UNION ALL ".join([
    _match("simple", _BOTH, f"{_X} AND {_Y}"), _match("partial", _BOTH, f"{_X} AND {_Y}"), _match("partial", "r.a IS NOT NULL AND r.b IS NULL", _X), _match("partial", "r.a IS NULL AND r.b IS NOT NULL", _Y),
    _match("full", _BOTH, f"{_X} AND {_Y}"), f"SELECT 'full', id, 'partial_null' FROM {_DOCS} r WHERE (r.a IS NULL) <> (r.b IS NULL)",
]))
def _(s, d):
    """Orphans of a composite key under each match: by null mask, on the columns that are there."""
    docs = read_table(s, d, "documents").select(F.col("doc_id").alias("id"), "project", "lang", "created_at")
    roster = docs.filter(F.col("created_at") < F.lit(_EARLY).cast("timestamp_ntz")).groupBy("project", "lang").agg(F.min("created_at").alias("created_at")).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    out = None
    for match in ("simple", "partial", "full"):
        ref = Reference("documents", ("project", "lang"), "roster", ("project", "lang"), match=match)
        rows = orphans(ref, docs, roster, updated="created_at").select(F.lit(match).alias("match"), "ref_id", "kind")
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES, ORACLE = R.queries, R.sql
