"""Queries of the composed reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import paths as ps
from loam.operators import gate, graph, reads
from loam.operators import retrieval as rt
from loam.plans import linkage, search
from loam.plans.common import BRANCH, IMPORTANCE, LINKS, LIVE, NOW, QUERIES as NODE_QUERIES, SHOWN, SLUG, T, Registry, links, node_queries, nodes, shown, terms, usable
from loam.plans.tree import _HOOK, _SCORE
from loam.visibility import live

R = Registry()
_EXTRACTED = search._EXTRACTED


def _extracted(s, d):
    return nodes(s, d).filter(live() & (F.col("origin") == "extracted"))


_HITS = f"(SELECT q.query, n.path FROM (SELECT *, list_distinct({terms('text')}) AS want FROM {NODE_QUERIES}) q JOIN (SELECT *, {terms('(coalesce(title, chr(0)) || chr(32) || coalesce(body, chr(0)))')} AS w FROM {_EXTRACTED}) n ON (len(want) > 0 AND list_has_all(w, want)) OR (q.text <> '' AND (contains(lower(coalesce(n.title, '')), lower(q.text)) OR contains(lower(coalesce(n.body, '')), lower(q.text)))))"


@R.add("search", f"""WITH h AS MATERIALIZED (SELECT * FROM ({search._HYBRID})), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, path) AS position FROM ({search._vec(20, _EXTRACTED)}) WHERE sim >= 0.85)
SELECT 'hit' AS kind, query, position, path, CAST(NULL AS VARCHAR) AS other, retrieval_score AS score FROM h
UNION ALL SELECT DISTINCT 'contradiction', h.query, CAST(NULL AS BIGINT), h.path, o.path, CAST(NULL AS DOUBLE) FROM h JOIN {SHOWN} n ON n.path = h.path JOIN {search._DIRECTED} l ON l.id = n.id JOIN {SHOWN} o ON o.id = l.other WHERE l.rel_type = 'contradicts'
UNION ALL SELECT 'tripwire', query, position, path, NULL, sim FROM t WHERE position <= 3
UNION ALL SELECT 'hidden', query, NULL, NULL, NULL, CAST(count(DISTINCT path) AS DOUBLE) FROM {_HITS} GROUP BY query""")
def _(s, d):
    return reads.search(shown(s, d), _extracted(s, d), links(s, d), node_queries(s, d), NOW)


_LIVE_NODES = f"(SELECT * FROM memory_nodes WHERE {LIVE})"
_PLAIN = search._LEX.replace(SHOWN, _LIVE_NODES)


@R.add("plain_search", f"""WITH l AS MATERIALIZED (SELECT * FROM ({_PLAIN})), s AS (SELECT q.query, n.path, 0.0 AS score FROM {NODE_QUERIES} q JOIN {_LIVE_NODES} n ON contains(lower(coalesce(n.title, '')), lower(q.text)) OR contains(lower(coalesce(n.body, '')), lower(q.text)) WHERE q.text <> '' AND q.query NOT IN (SELECT query FROM l))
SELECT query, path, position FROM (SELECT query, path, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS position FROM (SELECT * FROM l UNION ALL SELECT * FROM s)) WHERE position <= 30""")
def _(s, d):
    return reads.plain_search(nodes(s, d).filter(live()), node_queries(s, d)).withColumn("position", F.col("position").cast("long"))


@R.add("read_nodes", f"""WITH m AS (SELECT path, id, coalesce(valid_until < {T}, false) AS expired FROM memory_nodes WHERE {LIVE} AND type IN ('feedback', 'user')), l AS (SELECT m.path, l.direction, l.rel_type, o.path AS other FROM m JOIN {search._DIRECTED} l ON l.id = m.id JOIN {_LIVE_NODES} o ON o.id = l.other)
SELECT path, 'node' AS kind, CAST(NULL AS VARCHAR) AS rel_type, CAST(NULL AS VARCHAR) AS other, expired FROM m UNION ALL SELECT path, direction, rel_type, other, CAST(NULL AS BOOLEAN) FROM l UNION ALL SELECT DISTINCT path, 'contradicts', rel_type, other, CAST(NULL AS BOOLEAN) FROM l WHERE rel_type = 'contradicts'""")
def _(s, d):
    return reads.read_nodes(nodes(s, d), links(s, d), nodes(s, d).filter("type in ('feedback', 'user')").select("path"), NOW)


_CURATED = f"(SELECT * FROM memory_nodes WHERE {LIVE} AND origin = 'curated')"
_TAGGED = f"(SELECT from_id AS id, to_id AS other, 'out' AS direction, rel_type, link_origin FROM {LINKS} UNION ALL SELECT to_id, from_id, 'in', rel_type, link_origin FROM {LINKS})"


@R.add("graph_query", f"""WITH h AS (SELECT query, path, id, position FROM (SELECT v.query, v.path, n.id, row_number() OVER (PARTITION BY v.query ORDER BY {search._FINAL.format(s='v.sim')} DESC, v.path) AS position FROM ({search._vec(15, _CURATED)}) v JOIN {_CURATED} n ON n.path = v.path) WHERE position <= 5)
SELECT h.query, h.position, h.path, l.direction, l.rel_type, l.neighbour, l.tag FROM h LEFT JOIN (SELECT l.id, l.direction, l.rel_type, o.path AS neighbour, CASE WHEN link_origin = 'explicit' THEN 'EXPLICIT' ELSE 'INFERRED' END AS tag FROM {_TAGGED} l JOIN {_LIVE_NODES} o ON o.id = l.other) l ON l.id = h.id""")
def _(s, d):
    return reads.graph_query(nodes(s, d), links(s, d), node_queries(s, d), NOW)


_MINE = f"(SELECT *, {SLUG} AS project, coalesce(list_has_any(pin_triggers, ['start']), false) AS pinned FROM {_HOOK.format(source=SHOWN)} WHERE {SLUG} IS NOT NULL)"


@R.add("session_digest", f"""WITH m AS MATERIALIZED (SELECT * FROM {_MINE}), c AS (SELECT project, list(x ORDER BY i) AS centroid FROM (SELECT project, i, avg(CAST(e AS DOUBLE)) AS x FROM (SELECT project, unnest(embedding) AS e, unnest(range(1, 385)) AS i FROM m WHERE {usable('embedding')}) GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT p.project, n.path, round({IMPORTANCE} + least(coalesce(access_count, 0), 20) / 100.0 + CASE WHEN c.centroid IS NOT NULL AND n.embedding IS NOT NULL THEN 0.8 * CASE WHEN len(n.embedding) = 384 AND len(list_filter(n.embedding, lambda x: x <> 0)) > 0 THEN list_cosine_similarity(CAST(n.embedding AS DOUBLE[]), c.centroid) ELSE 0.0 END ELSE 0.0 END, 9) AS score, length(concat_ws(' ', title, hook, n.path)) + 1 AS chars
  FROM (SELECT DISTINCT project FROM m) p LEFT JOIN c ON c.project = p.project CROSS JOIN (SELECT * FROM {_HOOK.format(source=SHOWN)} WHERE (starts_with(path, '/user/') OR starts_with(path, '/feedback/')) AND round(CAST(importance AS DOUBLE), 6) >= 0.7) n),
l AS (SELECT project, path, CASE WHEN pinned THEN 'pin' ELSE 'index' END AS section, CASE WHEN pinned THEN round({IMPORTANCE}, 9) ELSE {_SCORE} END AS score, CASE WHEN pinned THEN length(concat_ws(' ', title, path, substr(body, 1, 1500))) ELSE length(concat_ws(' ', path, title, hook)) END + 1 AS chars FROM m
  UNION ALL SELECT project, path, 'rule', score, chars FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, path) AS r FROM g) WHERE r <= 20),
r AS MATERIALIZED (SELECT project, path, section, row_number() OVER (PARTITION BY project, section ORDER BY score DESC, path) AS position, sum(chars) OVER (PARTITION BY project, section ORDER BY score DESC, path ROWS UNBOUNDED PRECEDING) AS run FROM l),
u1 AS (SELECT p.project, coalesce(max(run), 0) AS u FROM (SELECT DISTINCT project FROM m) p LEFT JOIN r ON r.project = p.project AND section = 'pin' AND run <= 8000 GROUP BY 1),
u2 AS (SELECT u1.project, u1.u, coalesce(max(run), 0) AS v FROM u1 LEFT JOIN r ON r.project = u1.project AND section = 'index' AND run <= floor((8000 - u1.u) * 0.7) GROUP BY 1, 2),
f AS (SELECT r.*, run <= CASE section WHEN 'pin' THEN 8000 WHEN 'index' THEN floor((8000 - u) * 0.7) ELSE 8000 - u - v END AS fits FROM r JOIN u2 ON u2.project = r.project)
SELECT project, section, position, path, CAST(NULL AS BIGINT) AS n FROM f WHERE fits UNION ALL SELECT project, 'omitted', NULL, NULL, count(*) FROM f WHERE NOT fits AND section <> 'pin' GROUP BY 1""")
def _(s, d):
    n = shown(s, d)
    return reads.session_digest(n, n.select(ps.project_slug(F.col("path")).alias("project")).filter("project is not null"), NOW)


@R.add("session_pins", f"SELECT project, row_number() OVER (PARTITION BY project ORDER BY {IMPORTANCE} DESC, path) AS position, path, title FROM {_MINE} WHERE pinned")
def _(s, d):
    return reads.session_pins(shown(s, d))


@R.add("context", f"""SELECT 'branch' AS kind, {BRANCH} AS name, count(*) AS n, max(updated_at) AS at FROM {_CURATED} WHERE type <> 'category' GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'recent', path, CAST(NULL AS BIGINT), updated_at FROM {_CURATED} WHERE type <> 'category' AND NOT contains(path, '/auto/') ORDER BY updated_at DESC, path LIMIT 15) UNION ALL SELECT 'extracted', NULL, count(*), NULL FROM {_EXTRACTED}""")
def _(s, d):
    return reads.context(nodes(s, d), NOW)


@R.add("graph_report", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {linkage._UND}), w AS (SELECT path AS a, path AS b FROM {SHOWN} UNION SELECT w.a, e.b FROM w JOIN e ON e.a = w.b), c AS MATERIALIZED (SELECT component, count(*) AS n FROM (SELECT a, min(b) AS component FROM w GROUP BY 1) GROUP BY 1 HAVING count(*) >= 2), g AS MATERIALIZED (SELECT * FROM {linkage._DEGREE})
SELECT 'nodes' AS kind, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, count(*) AS n FROM g UNION ALL SELECT 'links', NULL, NULL, count(*) FROM {linkage._SUB} UNION ALL SELECT 'clusters', NULL, NULL, count(*) FROM c UNION ALL SELECT 'orphans', NULL, NULL, count(*) FROM g WHERE degree = 0
UNION ALL SELECT * FROM (SELECT 'hub', path, NULL, degree FROM g WHERE degree > 0 ORDER BY degree DESC, path LIMIT 8) UNION ALL SELECT 'cluster', component, NULL, n FROM c UNION ALL SELECT 'orphan', path, NULL, NULL FROM g WHERE degree = 0 UNION ALL SELECT DISTINCT 'contradiction', from_path, to_path, CAST(NULL AS BIGINT) FROM {linkage._NAMED} WHERE rel_type = 'contradicts'""")
def _(s, d):
    return reads.graph_report(shown(s, d), links(s, d))


_OPEN = search._CAND + " AND NOT (starts_with(n.path, '/projects/') AND coalesce(n.access_count, 0) = 0)"


@R.add("retrieve", f"SELECT query, path, confidence, position FROM (SELECT query, path, confidence, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, importance DESC, path) AS position FROM ({search._PROB.replace(search._CAND, _OPEN)}) WHERE confidence >= 0.5 AND importance >= 0.5) WHERE position <= 1")
def _(s, d):
    """Each node never accessed counts as shown three times without use; a query isn't told itself."""
    q, n = node_queries(s, d), shown(s, d)
    feedback = n.filter(F.coalesce("access_count", F.lit(0)) == 0).select("path", F.lit(False).alias("used"), F.explode(F.sequence(F.lit(1), F.lit(3))))
    told = q.select("query", F.col("query").alias("path"))
    found = reads.retrieve(search._coverage(s, d, q, ["importance"]), rt.vector_arm(n, q, 10, rt.DIMS), n, gate.never_used(feedback, prefixes=("/projects/",)), told)
    return found.withColumn("position", F.col("position").cast("long"))


@R.add("infer_links_top", f"SELECT p.* FROM (SELECT * FROM {linkage._PAIRS} WHERE sim >= 0.82) p WHERE NOT EXISTS (SELECT 1 FROM {linkage._NAMED} n WHERE least(n.from_path, n.to_path) = p.path_a AND greatest(n.from_path, n.to_path) = p.path_b) ORDER BY sim DESC, path_a, path_b LIMIT 20")
def _(s, d):
    """The report of new links: the first 20 of all."""
    from loam.operators.neighbours import similar_pairs

    return graph.unlinked(similar_pairs(shown(s, d), 0.82, rt.DIMS), shown(s, d), links(s, d)).orderBy(F.desc("sim"), "path_a", "path_b").limit(20)


QUERIES, ORACLE = R.queries, R.sql
