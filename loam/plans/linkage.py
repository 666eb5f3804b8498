"""Queries on the link graph, inferred links, consolidation, the journal and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import paths as ps
from loam.operators import consolidate, graph, journal, linking, mutate, neighbours, stats
from loam.operators.retrieval import vector_arm
from loam.plans.tree import _DATED as DATED
from loam.plans.common import DIMS, DOC, LINKS, LIVE, NOW, SHOWN, SLUG, T, Registry, links, nodes, shown, terms, usable
from loam.session import lookup_join, materialize, read_table
from loam.visibility import visible

R = Registry()
#: Similarity of the pairs that links are inferred from, and of duplicates.
LEAST, DUPLICATE = 0.75, 0.85

_NAMED = f"(SELECT a.path AS from_path, b.path AS to_path, l.rel_type, l.link_origin, l.confidence FROM {LINKS} l JOIN {SHOWN} a ON a.id = l.from_id JOIN {SHOWN} b ON b.id = l.to_id)"
_SUB = f"(SELECT l.* FROM {LINKS} l WHERE l.from_id IN (SELECT id FROM {SHOWN}) AND l.to_id IN (SELECT id FROM {SHOWN}))"


@R.add("named_links", f"SELECT from_path, to_path, rel_type, link_origin, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM {_NAMED}")
def _(s, d):
    return graph.named_links(shown(s, d), links(s, d)).withColumn("confidence", F.round(F.col("confidence").cast("double"), 6))


_DEGREE = f"(SELECT n.path, coalesce(e.n, 0) AS degree FROM {SHOWN} n LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT from_id AS id FROM {_SUB} UNION ALL SELECT to_id FROM {_SUB}) GROUP BY id) e ON e.id = n.id)"


@R.add("degree_topn", f"SELECT path, degree FROM {_DEGREE} ORDER BY degree DESC, path LIMIT 10")
def _(s, d):
    n = shown(s, d)
    return graph.degrees(n, graph.subgraph(n, links(s, d))).orderBy(F.desc("degree"), "path").limit(10)


@R.add("degrees", f"SELECT * FROM {_DEGREE}")
def _(s, d):
    n = shown(s, d)
    return graph.degrees(n, graph.subgraph(n, links(s, d)))


@R.add("orphans_scoped", f"SELECT path FROM {_DEGREE} WHERE degree = 0")
def _(s, d):
    n = shown(s, d)
    return graph.orphan_nodes(n, graph.subgraph(n, links(s, d)))


@R.add("orphans_anti", f"SELECT path FROM {SHOWN} WHERE id NOT IN (SELECT from_id FROM {LINKS} UNION SELECT to_id FROM {LINKS})")
def _(s, d):
    return graph.orphan_nodes(shown(s, d), links(s, d))


_UND = f"(SELECT from_path AS a, to_path AS b FROM {_NAMED} WHERE from_path <> to_path UNION SELECT to_path, from_path FROM {_NAMED} WHERE from_path <> to_path)"


@R.add("components", f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_UND}), r AS (SELECT path AS a, path AS b FROM {SHOWN} UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS path, min(b) AS component, count(*) AS size FROM r GROUP BY 1")
def _(s, d):
    return graph.node_components(shown(s, d), links(s, d))


_START = f"(SELECT path FROM {_DEGREE} ORDER BY degree DESC, path LIMIT 1)"


@R.add("bfs_distance", f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_UND}), w AS (SELECT path AS node, 0 AS hops FROM {_START} UNION SELECT e.b, w.hops + 1 FROM w JOIN e ON e.a = w.node WHERE w.hops < 6) SELECT node, min(hops) AS hops FROM w GROUP BY node")
def _(s, d):
    n, l = shown(s, d), links(s, d)  # noqa: E741
    start = graph.degrees(n, graph.subgraph(n, l)).orderBy(F.desc("degree"), "path").first()
    e = graph.named_links(n, l).select(F.col("from_path").alias("src"), F.col("to_path").alias("dst"))
    return graph.distances(e, start["path"] if start else "").select("node", "hops")


_PAIRS = f"(SELECT a.path AS path_a, b.path AS path_b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS sim FROM {SHOWN} a JOIN {SHOWN} b ON a.path < b.path WHERE {usable('a.embedding')} AND {usable('b.embedding')})"
_BOTH = f"(WITH p AS MATERIALIZED (SELECT * FROM {_PAIRS}) SELECT path_a AS a, path_b AS b, sim FROM p UNION ALL SELECT path_b, path_a, sim FROM p)"
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM {_BOTH})"


def _ranked(s, d) -> DataFrame:
    return materialize(neighbours.nearest(shown(s, d), linking.K_SEMANTIC, DIMS))


@R.add("all_pairs_cosine", f"SELECT * FROM {_PAIRS} WHERE sim >= {LEAST}")
def _(s, d):
    return neighbours.similar_pairs(shown(s, d), LEAST, DIMS)


@R.add("infer_links", f"SELECT p.* FROM (SELECT * FROM {_PAIRS} WHERE sim >= {LEAST}) p WHERE NOT EXISTS (SELECT 1 FROM {_NAMED} n WHERE least(n.from_path, n.to_path) = p.path_a AND greatest(n.from_path, n.to_path) = p.path_b)")
def _(s, d):
    return graph.unlinked(neighbours.similar_pairs(shown(s, d), LEAST, DIMS), shown(s, d), links(s, d))


@R.add("knn_self_join", f"SELECT a, b, rank FROM {_RANKED} WHERE rank <= 15")
def _(s, d):
    return _ranked(s, d).filter("rank <= 15").select("a", "b", F.col("rank").cast("long").alias("rank"))


@R.add("csls_hub", f"SELECT a, round(avg(sim), 9) AS hub FROM {_RANKED} WHERE rank <= 10 GROUP BY a")
def _(s, d):
    return linking.hub_scores(_ranked(s, d))


@R.add("shared_rank", f"SELECT a, b, rank() OVER (PARTITION BY a ORDER BY sim DESC) AS rank FROM {_RANKED} WHERE rank <= 15")
def _(s, d):
    return linking.shared_rank(_ranked(s, d)).select("a", "b", F.col("rank").cast("long").alias("rank"))


_VECTORS = f"(SELECT p.path, p.term, df, ln(((SELECT count(*) FROM {SHOWN}) + 1.0) / (df + 0.5)) AS w FROM (SELECT path, unnest(list_distinct({terms(DOC)})) AS term FROM {SHOWN}) p JOIN (SELECT term, count(*) AS df FROM (SELECT path, unnest(list_distinct({terms(DOC)})) AS term FROM {SHOWN}) GROUP BY term) f ON f.term = p.term)"


@R.add("postings_join", f"SELECT a, b, weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS r FROM (SELECT x.path AS a, y.path AS b, round(sum(x.w * x.w), 9) AS weight FROM {_VECTORS} x JOIN {_VECTORS} y ON x.term = y.term AND x.path <> y.path WHERE x.df <= 80 AND y.df <= 80 GROUP BY 1, 2)) WHERE r <= 10")
def _(s, d):
    return linking.rare_term_pairs(linking.idf_vectors(shown(s, d)))


_EXPLICIT = f"(SELECT from_path AS a, to_path AS b FROM {_NAMED} WHERE from_path <> to_path AND link_origin = 'explicit' UNION SELECT to_path, from_path FROM {_NAMED} WHERE from_path <> to_path AND link_origin = 'explicit')"
_TWO_HOP = f"SELECT DISTINCT x.b AS a, y.b AS b FROM {_EXPLICIT} x JOIN {_EXPLICIT} y ON x.a = y.a AND x.b < y.b"


@R.add("two_hop", _TWO_HOP)
def _(s, d):
    return linking.two_hop(linking.deliberate(graph.named_links(shown(s, d), links(s, d))))


def _mentions(source: str) -> str:
    """Mentions in (path, body) as SQL."""
    last, folder = "list_extract(string_split({0}, '/'), -1)", "regexp_replace({0}, '/[^/]*$', '')"
    return f"""(WITH n AS MATERIALIZED (SELECT path, body FROM {source}), w AS (SELECT DISTINCT path, unnest(regexp_extract_all(coalesce(body, ''), '{linking.WIKI}', 1)) AS name FROM n),
h AS (SELECT w.path, w.name, n.path AS mentioned, ({folder.format('w.path')} = {folder.format('n.path')}) AS near FROM w JOIN n ON {last.format('n.path')} = w.name),
c AS (SELECT path, mentioned, count(*) OVER (PARTITION BY path, name) AS k FROM (SELECT *, max(near) OVER (PARTITION BY path, name) AS best FROM h) WHERE near = best)
SELECT path, mentioned FROM c WHERE k = 1 AND path <> mentioned UNION SELECT x.path, x.m FROM (SELECT path, rtrim(unnest(regexp_extract_all(coalesce(body, ''), '({linking.PATH})', 1)), '.') AS m FROM n) x JOIN n ON n.path = x.m WHERE x.path <> x.m)"""


_TOLD = f"(SELECT path, 'see ' || coalesce(CASE WHEN regexp_replace(path, '/[^/]*$', '') <> '' THEN regexp_replace(path, '/[^/]*$', '') END, '') || ' and [[' || coalesce(slug, '') || ']]' AS body FROM memory_nodes WHERE {LIVE})"


@R.add("mentions", f"SELECT path, mentioned FROM {_mentions(_TOLD)}")
def _(s, d):
    """Bodies name no paths in these tables; each node's body is given its parent's path and a slug to resolve."""
    n = nodes(s, d).filter(F.col("deleted_at").isNull()).select("path", F.concat(F.lit("see "), F.coalesce(ps.parent_path(F.col("path")), F.lit("")), F.lit(" and [["), F.coalesce("slug", F.lit("")), F.lit("]]")).alias("body"))
    return linking.mentions(n)


_LEXICAL = f"SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS r FROM (SELECT x.path AS a, y.path AS b, round(sum(x.w * x.w), 9) AS weight FROM {_VECTORS} x JOIN {_VECTORS} y ON x.term = y.term AND x.path <> y.path WHERE x.df <= 80 AND y.df <= 80 GROUP BY 1, 2)) WHERE r <= 10"
_CANDIDATES = f"(SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT a, b FROM {_RANKED} WHERE rank <= 15 UNION ALL {_LEXICAL} UNION ALL {_TWO_HOP} UNION ALL SELECT path, mentioned FROM {_mentions(SHOWN)} UNION ALL SELECT from_path, to_path FROM {_NAMED} WHERE link_origin = 'inferred') WHERE a <> b)"


_NAMES = f"(SELECT path, substr(slug, 1, 6) AS name FROM {SHOWN} WHERE slug IS NOT NULL AND slug <> '')"


@R.add("resolve_names", f"SELECT path, name, arg_min(target, row(o, target)) AS target FROM (SELECT w.path, w.name, n.path AS target, CASE WHEN regexp_replace(w.path, '/[^/]*$', '') = regexp_replace(n.path, '/[^/]*$', '') THEN 0 ELSE 1 END AS o FROM {_NAMES} w JOIN {SHOWN} n ON starts_with(list_extract(string_split(n.path, '/'), -1), w.name) AND n.path <> w.path) GROUP BY 1, 2")
def _(s, d):
    """The first six letters of each node's own slug, as a name written in it, resolved to another node."""
    n = shown(s, d)
    return linking.resolve_names(n.filter("slug is not null").select("path", F.expr("substring(slug, 1, 6)").alias("name")), n)


def _mentioned(s, d) -> DataFrame:
    return materialize(linking.mentions(shown(s, d)))


def _pairs(s, d, mentioned: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    ranked, vectors = _ranked(s, d), materialize(linking.idf_vectors(shown(s, d)))
    named = materialize(graph.named_links(shown(s, d), links(s, d)))
    pairs = materialize(linking.candidates(ranked, vectors, named, _mentioned(s, d) if mentioned is None else mentioned))
    return pairs, ranked, vectors, named


_FEATURES = f"""(WITH r AS MATERIALIZED (SELECT * FROM {_RANKED}), c AS MATERIALIZED (SELECT * FROM {_CANDIDATES}), v AS MATERIALIZED (SELECT * FROM {_VECTORS}), hub AS (SELECT a, round(avg(sim), 9) AS hub FROM r WHERE rank <= 10 GROUP BY a), norm AS (SELECT path, sqrt(sum(w * w)) AS n FROM v GROUP BY path),
t AS (SELECT c.a, c.b, sum(x.w * x.w) AS d FROM c JOIN v x ON x.path = c.a JOIN v y ON y.path = c.b AND y.term = x.term GROUP BY 1, 2), u AS MATERIALIZED (SELECT * FROM {_EXPLICIT}), deg AS (SELECT a, count(*) AS deg FROM u GROUP BY a),
aa AS (SELECT c.a, c.b, sum(1.0 / ln(1.0 + deg.deg)) AS s FROM c JOIN u x ON x.a = c.a JOIN u y ON y.a = c.b AND y.b = x.b JOIN deg ON deg.a = x.b GROUP BY 1, 2)
SELECT c.a, c.b, r1.sim, coalesce(round(2 * r1.sim - h1.hub - h2.hub, 9), 0.0) AS semantic, coalesce(round(1.0 / sqrt(CAST(r1.rank * r2.rank AS DOUBLE)), 9), 0.0) AS mutual_rank, round(coalesce(t.d / (n1.n * n2.n), 0.0), 9) AS terms,
CASE WHEN len(string_split(c.a, '/')) > 3 AND len(string_split(c.b, '/')) > 3 AND split_part(c.a, '/', 3) = split_part(c.b, '/', 3) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS project, CASE WHEN regexp_replace(c.a, '/[^/]*$', '') = regexp_replace(c.b, '/[^/]*$', '') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS folder, round(ln(1.0 + coalesce(aa.s, 0.0)), 9) AS neighbours, greatest(r1.rank, r2.rank) AS rank
FROM c LEFT JOIN r r1 ON r1.a = c.a AND r1.b = c.b LEFT JOIN r r2 ON r2.a = c.b AND r2.b = c.a LEFT JOIN hub h1 ON h1.a = c.a LEFT JOIN hub h2 ON h2.a = c.b LEFT JOIN t ON t.a = c.a AND t.b = c.b LEFT JOIN norm n1 ON n1.path = c.a LEFT JOIN norm n2 ON n2.path = c.b LEFT JOIN aa ON aa.a = c.a AND aa.b = c.b)"""
_W = linking.WEIGHTS
_MENTION = f"SELECT DISTINCT least(path, mentioned) AS a, greatest(path, mentioned) AS b FROM {_mentions(SHOWN)}"
_SCORED = f"(SELECT f.*, round(greatest(1.0 / (1.0 + exp(-greatest(-40.0, least(40.0, {_W['bias']} + " + " + ".join(f"{_W[f]} * {f}" for f in linking.FEATURES) + f")))), CASE WHEN sim >= 0.9 THEN 0.9 ELSE 0.0 END, CASE WHEN m.a IS NOT NULL THEN 0.95 ELSE 0.0 END), 9) AS confidence FROM {_FEATURES} f LEFT JOIN ({_MENTION}) m ON m.a = f.a AND m.b = f.b)"
#: Pairs that a reviewer settled, here: those of the links that supersede something.
_DECIDED = f"(SELECT DISTINCT least(from_path, to_path) AS a, greatest(from_path, to_path) AS b FROM {_NAMED} WHERE rel_type = 'supersedes')"


def _none(s, *columns: str) -> DataFrame:
    return s.createDataFrame([], ", ".join(f"{c} string" for c in columns))


@R.add("link_candidates", f"SELECT a, b FROM {_CANDIDATES}")
def _(s, d):
    return _pairs(s, d)[0]


@R.add("link_features", f"SELECT a, b, semantic, mutual_rank, terms, project, folder, neighbours FROM {_FEATURES}")
def _(s, d):
    return _featured(s, d, *_pairs(s, d)).drop("sim", "rank", "common")


def _featured(s, d, pairs: DataFrame, ranked: DataFrame, vectors: DataFrame, named: DataFrame) -> DataFrame:
    return linking.features(pairs, ranked, vectors, named, materialize(neighbours.pair_ranks(shown(s, d), ranked, pairs, DIMS)))


def _scored(s, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    mentioned = _mentioned(s, d)
    pairs, ranked, vectors, named = _pairs(s, d, mentioned)
    return linking.score(_featured(s, d, pairs, ranked, vectors, named), mentioned), named, vectors, mentioned


def _decided(named: DataFrame) -> DataFrame:
    return linking.canonical(named.filter("rel_type = 'supersedes'").select("from_path", "to_path"))


@R.add("link_confidence", f"SELECT a, b, confidence FROM {_SCORED}")
def _(s, d):
    return _scored(s, d)[0].select("a", "b", "confidence")


@R.add("link_routing", f"""WITH x AS (SELECT a, b, confidence FROM {_SCORED}), p AS (SELECT least(from_path, to_path) AS a, greatest(from_path, to_path) AS b, link_origin, confidence FROM {_NAMED})
SELECT a, b, confidence, action FROM (SELECT x.a, x.b, x.confidence, CASE WHEN i.a IS NOT NULL THEN CASE WHEN i.old IS NULL OR abs(x.confidence - i.old) > 0.0001 THEN 'rescore' END WHEN d.a IS NOT NULL THEN NULL WHEN x.confidence >= 0.7 THEN 'link' WHEN x.confidence >= 0.35 THEN 'suggest' END AS action
FROM x LEFT JOIN (SELECT a, b, max(confidence) AS old FROM p WHERE link_origin = 'inferred' GROUP BY 1, 2) i ON i.a = x.a AND i.b = x.b LEFT JOIN {_DECIDED} d ON d.a = x.a AND d.b = x.b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.link_origin = 'explicit' AND p.a = x.a AND p.b = x.b)) WHERE action IS NOT NULL""")
def _(s, d):
    scored, named, _v, _m = _scored(s, d)
    return linking.route(scored, named, _decided(named))


@R.add("link_evidence", f"""WITH s AS MATERIALIZED (SELECT * FROM {_SCORED}), v AS MATERIALIZED (SELECT * FROM {_VECTORS}), u AS MATERIALIZED (SELECT * FROM {_EXPLICIT}), m AS (SELECT least(path, mentioned) AS a, greatest(path, mentioned) AS b, min(path) AS by_path FROM {_mentions(SHOWN)} GROUP BY 1, 2),
t AS (SELECT a, b, string_agg(term, ', ' ORDER BY w DESC, term) AS terms FROM (SELECT s.a, s.b, x.term, x.w, row_number() OVER (PARTITION BY s.a, s.b ORDER BY x.w DESC, x.term) AS r FROM s JOIN v x ON x.path = s.a JOIN v y ON y.path = s.b AND y.term = x.term WHERE s.terms >= 0.05 AND regexp_full_match(x.term, '\\p{{L}}{{5,}}')) WHERE r <= 3 GROUP BY 1, 2),
c AS (SELECT s.a, s.b, count(*) AS n FROM s JOIN u x ON x.a = s.a JOIN u y ON y.a = s.b AND y.b = x.b GROUP BY 1, 2)
SELECT s.a, s.b, coalesce(nullif(concat_ws('; ', 'named in ' || m.by_path, CASE WHEN sim >= 0.9 THEN printf('near duplicate (cos %.2f)', sim) WHEN sim >= 0.5 AND rank <= 5 THEN printf('similar (cos %.2f, among the nearest 5 of each other)', sim) END, CASE WHEN project > 0 THEN 'same project (' || split_part(s.a, '/', 3) || ')' WHEN folder > 0 THEN 'same folder' END, CASE WHEN c.n > 0 THEN c.n || ' shared neighbours' END, 'shared terms: ' || t.terms), ''), 'model') AS evidence
FROM s LEFT JOIN m ON m.a = s.a AND m.b = s.b LEFT JOIN t ON t.a = s.a AND t.b = s.b LEFT JOIN c ON c.a = s.a AND c.b = s.b""")
def _(s, d):
    scored, _n, vectors, mentioned = _scored(s, d)
    return linking.evidence(scored, vectors, mentioned)


@R.add("link_fit")
def _(s, d):
    """(feature, weight, source) of the model fitted on the deliberate links."""
    mentioned = _mentioned(s, d)
    pairs, ranked, vectors, named = _pairs(s, d, mentioned)
    told = materialize(linking.labelled(named, linking.canonical(ranked.select("a", "b"), linking.rare_term_pairs(vectors).select("a", "b"), linking.two_hop(linking.deliberate(named))), mentioned))
    featured = _featured(s, d, told.select("a", "b"), ranked, vectors, named).join(told, ["a", "b"])
    weights, source = linking.fit(featured)
    return s.createDataFrame([(k, v, source) for k, v in weights.items()], "feature string, weight double, source string")


def _members(s, d) -> DataFrame:
    return materialize(shown(s, d).select("path", ps.project_slug(F.col("path")).alias("project")).filter("project is not null"))


def _spine(s, d) -> DataFrame:
    mentioned, member = _mentioned(s, d), _members(s, d)
    pairs, ranked, vectors, named = _pairs(s, d, mentioned)
    pairs = materialize(linking.spine_pairs(member, pairs))
    scored = linking.score(_featured(s, d, pairs, ranked, vectors, named), mentioned)
    return linking.spine(scored, member, named.select(F.col("from_path").alias("a"), F.col("to_path").alias("b")), _decided(named))


@R.add("project_spine")
def _(s, d):
    return _spine(s, d)


_MEMBER = f"(SELECT path, {SLUG} AS project FROM {SHOWN} WHERE {SLUG} IS NOT NULL)"


@R.add("project_spine_parts", f"SELECT project, count(*) AS members, CAST(1 AS BIGINT) AS parts FROM {_MEMBER} GROUP BY 1")
def _(s, d):
    """(project, members, parts) once the spine is added to the links: nothing is left apart."""
    member = _members(s, d)
    named = graph.named_links(shown(s, d), links(s, d)).select(F.col("from_path").alias("a"), F.col("to_path").alias("b"))
    edges = named.unionByName(_spine(s, d).select("a", "b")).join(member.select(F.col("path").alias("a"), "project"), "a").join(member.select(F.col("path").alias("b"), F.col("project").alias("pb")), "b").filter("project = pb")
    from loam.operators.components import connected_components

    part = member.join(connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("path"), "component"), "path", "left")
    return part.groupBy("project").agg(F.count(F.lit(1)).alias("members"), F.countDistinct(F.coalesce("component", "path")).alias("parts"))


_KEY = "row(coalesce(CAST(importance AS DOUBLE), 0.0), coalesce(access_count, 0), updated_at)"
_DUPLICATES = f"(SELECT CASE WHEN x.k >= y.k THEN p.path_a ELSE p.path_b END AS keep, CASE WHEN x.k >= y.k THEN p.path_b ELSE p.path_a END AS drop, sim FROM (SELECT * FROM {_PAIRS} WHERE sim >= {DUPLICATE}) p JOIN (SELECT path, {_KEY} AS k FROM memory_nodes) x ON x.path = p.path_a JOIN (SELECT path, {_KEY} AS k FROM memory_nodes) y ON y.path = p.path_b)"


@R.add("duplicate_keep", f"SELECT * FROM {_DUPLICATES}")
def _(s, d):
    return consolidate.duplicates(shown(s, d), DUPLICATE, DIMS)


_FOUND = f"""(SELECT 'duplicate' AS kind, list_sort([keep, drop]) AS sorted, keep || ',' || drop AS paths, '' AS extra FROM {_DUPLICATES} UNION ALL SELECT 'expired', [path], path, strftime(valid_until, '%Y-%m-%d') FROM memory_nodes WHERE {LIVE} AND origin = 'curated' AND valid_until < {T} - INTERVAL 14 DAYS
UNION ALL SELECT 'stale', [path], path, strftime(updated_at, '%Y-%m-%d') FROM memory_nodes WHERE {LIVE} AND origin = 'curated' AND type <> 'category' AND round(CAST(importance AS DOUBLE), 6) <= 0.4 AND len(coalesce(pin_triggers, [])) = 0 AND valid_until IS NULL AND updated_at < {T} - INTERVAL 180 DAYS
UNION ALL SELECT 'relative_dates', [path], path, dates FROM {DATED.format(source=f"(SELECT * FROM memory_nodes WHERE {LIVE} AND origin = 'curated')")})"""


@R.add("consolidation_queue", f"SELECT kind, paths, extra, substr(sha256(kind || '|' || array_to_string(sorted, '|') || '|' || extra), 1, 32) AS fingerprint FROM {_FOUND}")
def _(s, d):
    found = consolidate.proposals(nodes(s, d).filter(visible(NOW, include_expired=True)), shown(s, d), NOW, DUPLICATE, DIMS)
    return consolidate.enqueue(found, _none(s, "fingerprint")).withColumn("paths", F.array_join("paths", ","))


@R.add("graph_payload", f"SELECT 'node' AS kind, path AS a, NULL AS b, degree AS n FROM {_DEGREE} UNION ALL SELECT 'edge', from_path, to_path, count(*) FROM {_NAMED} GROUP BY 2, 3")
def _(s, d):
    return graph.graph_payload(shown(s, d), links(s, d))


@R.add("link_quality", f"SELECT count(*) AS n, count(*) FILTER (link_origin = 'inferred') AS inferred, round(avg(CAST(confidence AS DOUBLE)) FILTER (link_origin = 'inferred'), 6) AS avg_confidence, (SELECT count(*) FROM memory_nodes WHERE {LIVE} AND origin = 'curated' AND type <> 'category' AND id NOT IN (SELECT from_id FROM {LINKS} UNION SELECT to_id FROM {LINKS})) AS orphans FROM {LINKS}")
def _(s, d):
    return stats.link_quality(nodes(s, d), links(s, d))


@R.add("links_by_type", f"SELECT rel_type, link_origin, count(*) AS n FROM {LINKS} GROUP BY 1, 2")
def _(s, d):
    return stats.counts_by(links(s, d), "rel_type", "link_origin")


@R.add("project_centroids", f"SELECT project, count(*) AS dims, round(sum(m * m), 9) AS square FROM (SELECT project, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT {SLUG} AS project, unnest(embedding) AS x, unnest(range(1, 385)) AS i FROM {SHOWN} WHERE {usable('embedding')} AND {SLUG} IS NOT NULL) GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    from loam.functions.vector import centroid, usable_vector

    n = shown(s, d).filter(usable_vector(F.col("embedding"), DIMS)).withColumn("project", ps.project_slug(F.col("path"))).filter("project is not null")
    c = centroid(n, ["project"], "embedding")
    return c.select("project", F.size("centroid").cast("long").alias("dims"), F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x), 9).alias("square"))


# the journal

def _j(s, d) -> dict[str, DataFrame]:
    return {t: read_table(s, d, t) for t in ("projects", "milestones", "tasks", "logs")}


def _cur(t: str) -> str:
    return f"(SELECT DISTINCT ON (id) * FROM {t} WHERE {LIVE})"


@R.add("journal_rollup", f"""SELECT p.name AS project, coalesce(m.n, 0) AS milestones, coalesce(m.done, 0) AS milestones_done, coalesce(m.tasks, 0) AS tasks, coalesce(m.tasks_done, 0) AS tasks_done, CASE WHEN coalesce(m.tasks, 0) > 0 THEN round_even(100.0 * m.tasks_done / m.tasks, 1) ELSE 0.0 END AS done_pct, coalesce(g.n30, 0) AS logs_30d, g.last_log
FROM {_cur('projects')} p LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (completed) AS done, CAST(sum(coalesce(t.n, 0)) AS BIGINT) AS tasks, CAST(sum(coalesce(t.done, 0)) AS BIGINT) AS tasks_done FROM {_cur('milestones')} m LEFT JOIN (SELECT milestone_id, count(*) AS n, count(*) FILTER (completed) AS done FROM {_cur('tasks')} GROUP BY 1) t ON t.milestone_id = m.id GROUP BY 1) m ON m.project_id = p.id
LEFT JOIN (SELECT project_id, count(*) FILTER (logged_at >= {T} - INTERVAL 30 DAYS) AS n30, max(logged_at) AS last_log FROM {_cur('logs')} GROUP BY 1) g ON g.project_id = p.id""")
def _(s, d):
    return journal.rollup(**_j(s, d), now=NOW)


@R.add("active_tasks", f"SELECT p.name AS project, m.title AS milestone, t.id AS task_id, t.title AS task FROM {_cur('tasks')} t JOIN {_cur('milestones')} m ON m.id = t.milestone_id JOIN {_cur('projects')} p ON p.id = m.project_id WHERE NOT coalesce(t.completed, false) AND NOT coalesce(p.archived, false)")
def _(s, d):
    j = _j(s, d)
    return journal.active_tasks(j["projects"], j["milestones"], j["tasks"])


@R.add("filter_logs", f"SELECT p.name AS project, g.id, g.logged_at, g.level, g.worker, g.entry FROM {_cur('logs')} g JOIN {_cur('projects')} p ON p.id = g.project_id WHERE g.level = 'ERROR' ORDER BY g.logged_at DESC, g.id DESC LIMIT 50")
def _(s, d):
    j = _j(s, d)
    return journal.filter_logs(j["projects"], j["logs"], level="error")


@R.add("search_global", f"SELECT 'task' AS kind, CAST(id AS VARCHAR) AS id, title FROM {_cur('tasks')} WHERE contains(lower(coalesce(title, '')), 'index') UNION ALL SELECT 'milestone', CAST(id AS VARCHAR), title FROM {_cur('milestones')} WHERE contains(lower(coalesce(title, '')), 'index') UNION ALL SELECT 'log', CAST(id AS VARCHAR), entry FROM {_cur('logs')} WHERE contains(lower(coalesce(entry, '')), 'index') UNION ALL SELECT 'node', id, title FROM memory_nodes WHERE {LIVE} AND (contains(lower(coalesce(title, '')), 'index') OR contains(lower(coalesce(body, '')), 'index'))")
def _(s, d):
    j = {k: journal.current(v) for k, v in _j(s, d).items()}
    n = nodes(s, d).filter("deleted_at is null")
    return journal.search_everywhere({"task": (j["tasks"], ["title"]), "milestone": (j["milestones"], ["title"]), "log": (j["logs"].withColumn("title", F.col("entry")), ["title"]), "node": (n, ["title", "body"])}, ["index"])


@R.add("route_errors", "SELECT project_id, entry AS error_msg, logged_at AS created_at FROM logs WHERE upper(trim(level)) IN ('ERROR', 'CRITICAL', 'FATAL', 'EXCEPTION')")
def _(s, d):
    return journal.route_errors(read_table(s, d, "logs"))[1]


@R.add("log_retention", f"SELECT l.id, l.logged_at FROM logs l LEFT JOIN (SELECT id, CAST(json_extract_string(config, '$.log_retention_days') AS INTEGER) AS days FROM projects) p ON p.id = l.project_id WHERE p.days IS NULL OR l.logged_at IS NULL OR l.logged_at >= {T} - p.days * INTERVAL 1 DAY")
def _(s, d):
    j = _j(s, d)
    return mutate.retention(j["logs"], j["projects"], NOW).select("id", "logged_at")


@R.add("cascade", f"SELECT DISTINCT m.id, CASE WHEN p.id IS NOT NULL AND m.deleted_at IS NULL THEN {T} ELSE m.deleted_at END AS deleted_at FROM milestones m LEFT JOIN (SELECT DISTINCT id FROM projects WHERE deleted_at IS NOT NULL) p ON p.id = m.project_id")
def _(s, d):
    j = _j(s, d)
    return mutate.cascade(j["milestones"], j["projects"], "project_id", NOW).select("id", "deleted_at").distinct()


@R.add("health", f"SELECT (SELECT count(*) FROM {_cur('projects')}) AS projects, (SELECT CAST(sum(CASE WHEN archived THEN 1 ELSE 0 END) AS BIGINT) FROM {_cur('projects')}) AS archived, (SELECT count(*) FROM {_cur('milestones')}) AS milestones, (SELECT CAST(sum(CASE WHEN completed THEN 1 ELSE 0 END) AS BIGINT) FROM {_cur('milestones')}) AS milestones_done, (SELECT count(*) FROM {_cur('tasks')}) AS tasks, (SELECT CAST(sum(CASE WHEN completed THEN 1 ELSE 0 END) AS BIGINT) FROM {_cur('tasks')}) AS tasks_done, (SELECT round(avg(CAST(importance AS DOUBLE)), 2) FROM {_cur('memory_nodes')}) AS avg_importance")
def _(s, d):
    j = _j(s, d)
    return stats.health(j["projects"], j["milestones"], j["tasks"], nodes(s, d))


@R.add("longest_prefix", "SELECT c.c_name AS cwd, arg_max(n.n_name, length(n.n_name)) AS project FROM (SELECT '/w/' || lower(n_name) || '/' || c_name AS c_name FROM customer JOIN nation ON n_nationkey = c_nationkey) c JOIN (SELECT n_name, '/w/' || lower(n_name) AS dir FROM nation) n ON c.c_name = n.dir OR starts_with(c.c_name, n.dir || '/') GROUP BY 1")
def _(s, d):
    n = read_table(s, d, "nation").select(F.col("n_name").alias("project"), F.concat(F.lit("/w/"), F.lower("n_name")).alias("dir"), "n_nationkey")
    c = lookup_join(read_table(s, d, "customer").withColumn("n_nationkey", F.col("c_nationkey")), n.select("n_nationkey", "dir"), "n_nationkey").select(F.concat("dir", F.lit("/"), "c_name").alias("cwd"))
    return journal.project_of_folder(c, n.select("project", "dir"))


# the event log

_EVENTS = "(SELECT CAST(user_id AS VARCHAR) AS session, CASE WHEN event_type = 'purchase' THEN 'start' ELSE 'prompt' END AS event, CAST(json_extract_string(props, '$.k') AS BIGINT) AS chars, event_type = 'click' AS hit, event_type = 'view' AS semantic, value AS latency FROM events)"


def _events(s, d) -> DataFrame:
    e = read_table(s, d, "events")
    return e.select(F.col("user_id").cast("string").alias("session"), F.when(F.col("event_type") == "purchase", "start").otherwise("prompt").alias("event"), F.get_json_object("props", "$.k").cast("long").alias("chars"), (F.col("event_type") == "click").alias("hit"), (F.col("event_type") == "view").alias("semantic"), F.col("value").alias("latency"))


@R.add("event_metrics", f"SELECT count(*) AS sessions, CAST(sum(p) AS BIGINT) AS prompts, round(sum(h) / sum(p), 6) AS hit_rate, round(sum(v) / sum(p), 6) AS semantic_share, round(avg(c), 6) AS chars_per_session, round(sum(l) / sum(p), 6) AS avg_latency FROM (SELECT session, count(*) FILTER (event = 'prompt') AS p, count(*) FILTER (event = 'prompt' AND hit) AS h, count(*) FILTER (event = 'prompt' AND semantic) AS v, sum(coalesce(chars, 0)) AS c, sum(latency) FILTER (event = 'prompt') AS l FROM {_EVENTS} GROUP BY 1)")
def _(s, d):
    return stats.event_metrics(_events(s, d))


@R.add("top_exploded", "SELECT t AS value, count(*) AS n FROM (SELECT unnest(tags) AS t FROM memory_nodes) GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def _(s, d):
    return stats.most_common(nodes(s, d), "tags")


@R.add("use_rate", f"SELECT count(*) AS n, count(*) FILTER (used) AS used, round(count(*) FILTER (used) / nullif(count(*), 0), 6) AS rate FROM (SELECT event_type = 'click' AS used, ts FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS)")
def _(s, d):
    e = read_table(s, d, "events").select((F.col("event_type") == "click").alias("used"), F.col("ts").alias("injected_at"))
    return stats.use_rate(e, "2024-01-31 00:00:00", 10)


@R.add("byte_tail", "SELECT event_id, props FROM (SELECT event_id, props, sum(octet_length(encode(props)) + 1) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS b FROM events) WHERE b <= 20000")
def _(s, d):
    return stats.tail_bytes(read_table(s, d, "events").select("event_id", "props"), "event_id", "props", 20000)


@R.add("segment_attribution", "SELECT conv, CAST(prompt_no AS BIGINT) AS prompt_no, string_agg(event_type, ' ' ORDER BY event_id) FILTER (role = 'assistant') AS reply FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY event_id) AS prompt_no FROM (SELECT user_id AS conv, event_id, event_type, CASE WHEN event_type = 'purchase' THEN 'user' ELSE 'assistant' END AS role FROM events)) WHERE prompt_no > 0 GROUP BY 1, prompt_no")
def _(s, d):
    e = read_table(s, d, "events").select(F.col("user_id").alias("conv"), F.col("event_id").alias("turn"), F.when(F.col("event_type") == "purchase", "user").otherwise("assistant").alias("role"), F.col("event_type").alias("text"))
    return stats.attribute_replies(e).select("conv", "prompt_no", F.nullif("reply", F.lit("")).alias("reply"))


@R.add("vector_neighbours_by_tier", f"SELECT query, path, sim FROM (SELECT q.path AS query, n.path, round(list_cosine_similarity(CAST(n.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS sim, row_number() OVER (PARTITION BY q.path ORDER BY round(list_cosine_similarity(CAST(n.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) DESC, n.path) AS r FROM memory_nodes q, {SHOWN} n WHERE q.type = 'user' AND {usable('q.embedding')} AND {usable('n.embedding')}) WHERE r <= 5")
def _(s, d):
    q = nodes(s, d).filter("type = 'user'").select(F.col("path").alias("query"), F.col("embedding").alias("vector"))
    return vector_arm(shown(s, d), q, 5, DIMS)


QUERIES, ORACLE = R.queries, R.sql
