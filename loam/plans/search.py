"""Queries on retrieval, the gate and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import paths as ps
from loam.operators import gate
from loam.operators import retrieval as rt
from loam.operators.graph import links_of
from loam.plans.common import DIMS, DOC, IMPORTANCE, LINKS, LIVE, NOW, QUERIES as NODE_QUERIES, SHOWN, T, Registry, links, node_queries, nodes, shown, terms, usable
from loam.session import BROADCAST_ROWS, lookup_join, materialize, read_table
from loam.visibility import fresh, importance, live

R = Registry()
PROBE = [1.0 if i % 3 else -0.5 for i in range(DIMS)]
_PROBE = "[" + ", ".join(f"{x}" for x in PROBE) + "]::DOUBLE[]"

_POST = f"SELECT path, len(w) AS length, t AS term, count(*) AS tf FROM (SELECT path, w, unnest(w) AS t FROM (SELECT path, {terms(DOC)} AS w FROM {SHOWN})) GROUP BY ALL"
_QT = f"SELECT query, len(q) AS wanted, unnest(q) AS term FROM (SELECT query, list_distinct({terms('text')}) AS q FROM {NODE_QUERIES})"
_LEX = f"SELECT query, path, score FROM (SELECT query, path, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS r FROM (SELECT query, path, round(sum(tf / (1.0 + ln(1.0 + length))), 9) AS score FROM ({_POST}) p JOIN ({_QT}) q ON p.term = q.term GROUP BY query, path, wanted HAVING count(*) = wanted)) WHERE r <= 30"
_VEC_ALL = f"SELECT q.query, n.path, round(list_cosine_similarity(n.e, q.vector), 9) AS sim FROM (SELECT path, CAST(embedding AS DOUBLE[]) AS e FROM {{source}} WHERE {usable('embedding')}) n, (SELECT * FROM {NODE_QUERIES} WHERE {usable('vector')}) q"


def _vec(k: int, source: str = SHOWN) -> str:
    return f"SELECT query, path, sim FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, path) AS r FROM ({_VEC_ALL.replace('{source}', source)})) WHERE r <= {k}"


_FUSE = f"""SELECT coalesce(a.query, b.query) AS query, coalesce(a.path, b.path) AS path, a.path IS NOT NULL AS in_lexical, b.path IS NOT NULL AS in_vector, a.score, b.sim,
1.0 / (60 + coalesce(a.r, count(a.r) OVER w + 1)) + 1.0 / (60 + coalesce(b.r, count(b.r) OVER w + 1)) AS rrf, count(a.r) OVER w AS na, count(b.r) OVER w AS nb
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS r FROM ({_LEX})) a FULL JOIN (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, path) AS r FROM ({_vec(30)})) b ON a.query = b.query AND a.path = b.path
WINDOW w AS (PARTITION BY coalesce(a.query, b.query))"""
_FINAL = "round({s} * (0.5 + 0.5 * " + IMPORTANCE + f") + 1e-6 / (1.0 + CASE WHEN updated_at IS NULL THEN 365.0 ELSE greatest((epoch_us({T}) - epoch_us(updated_at)) / 86400000000.0, 0.0) END), 12)"
_HYBRID = f"""SELECT query, path, round(retrieval_score, 9) AS retrieval_score, position FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY final_score DESC, path) AS position FROM (
SELECT h.query, h.path, h.retrieval_score, {_FINAL.format(s='h.retrieval_score')} AS final_score FROM (
WITH f AS ({_FUSE}), found AS (SELECT query, path, CASE WHEN na > 0 AND nb > 0 THEN round(rrf, 12) ELSE coalesce(score, sim) END AS retrieval_score FROM f)
SELECT * FROM found UNION ALL
SELECT query, path, 0.1 FROM (SELECT q.query, n.path, row_number() OVER (PARTITION BY q.query ORDER BY n.path) AS r FROM {NODE_QUERIES} q JOIN {SHOWN} n ON contains(lower(coalesce(n.title, '')), lower(q.text)) OR contains(lower(coalesce(n.body, '')), lower(q.text)) WHERE q.text <> '' AND q.query NOT IN (SELECT query FROM found)) WHERE r <= 30
) h JOIN {SHOWN} n ON n.path = h.path)) WHERE position <= 20"""


@R.add("vector_topk", f"SELECT path, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_PROBE}), 9) AS sim FROM (SELECT * FROM {SHOWN} WHERE {usable('embedding')}) ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_PROBE}), 9) DESC, path LIMIT 30")
def _(s: SparkSession, d: str) -> DataFrame:
    from loam.functions.vector import literal_vector, usable_vector

    n = shown(s, d).filter(usable_vector(F.col("embedding"), DIMS))
    return rt.similar_to(n, literal_vector(PROBE), 30).select("path", "sim")


@R.add("fts_arm", _LEX)
def _(s, d):
    return rt.lexical_arm(shown(s, d), node_queries(s, d))


@R.add("vector_arm", f"SELECT query, path, sim FROM ({_vec(30)})")
def _(s, d):
    return rt.vector_arm(shown(s, d), node_queries(s, d), dims=DIMS)


@R.add("rrf_fuse", f"SELECT query, path, round(rrf, 9) AS rrf, in_lexical, in_vector FROM ({_FUSE})")
def _(s, d):
    q, n = node_queries(s, d), shown(s, d)
    return rt.fuse(rt.lexical_arm(n, q), rt.vector_arm(n, q, dims=DIMS)).select("query", "path", F.round("rrf", 9).alias("rrf"), "in_lexical", "in_vector")


def _hybrid(s, d, limit: int = 20) -> DataFrame:
    return rt.hybrid(shown(s, d), node_queries(s, d), NOW, limit, dims=DIMS)


@R.add("hybrid_search", _HYBRID)
def _(s, d):
    return _hybrid(s, d).select("query", "path", F.round("retrieval_score", 9).alias("retrieval_score"), F.col("position").cast("long").alias("position"))


@R.add("vector_rerank", f"SELECT query, path, position FROM (SELECT query, path, row_number() OVER (PARTITION BY query ORDER BY final_score DESC, path) AS position FROM (SELECT v.query, v.path, {_FINAL.format(s='v.sim')} AS final_score FROM ({_vec(30)}) v JOIN {SHOWN} n ON n.path = v.path)) WHERE position <= 8")
def _(s, d):
    n = shown(s, d)
    hits = rt.rerank(rt.vector_arm(n, node_queries(s, d), 30, DIMS).join(n.select("path", "importance", "updated_at"), "path"), "sim", NOW)
    return rt.top(hits, ["query"], [F.desc("final_score"), F.col("path")], 8, "position").select("query", "path", F.col("position").cast("long").alias("position"))


_EXTRACTED = f"(SELECT * FROM memory_nodes WHERE {LIVE} AND origin = 'extracted')"


@R.add("tripwire", f"SELECT query, path, sim FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, path) AS r FROM ({_vec(20, _EXTRACTED)}) WHERE sim >= 0.85) WHERE r <= 3")
def _(s, d):
    n = nodes(s, d).filter(live() & (F.col("origin") == "extracted"))
    return rt.tripwire(n, node_queries(s, d), dims=DIMS).select("query", "path", "sim")


_DIRECTED = f"(SELECT from_id AS id, to_id AS other, 'out' AS direction, rel_type FROM {LINKS} UNION ALL SELECT to_id, from_id, 'in', rel_type FROM {LINKS})"


@R.add("links_in_out", f"SELECT n.path, l.direction, l.rel_type, o.path AS neighbour FROM {SHOWN} n JOIN {_DIRECTED} l ON l.id = n.id JOIN memory_nodes o ON o.id = l.other")
def _(s, d):
    other = nodes(s, d).select(F.col("id").alias("other"), F.col("path").alias("neighbour"))
    return rt.directed(links(s, d)).join(shown(s, d).select("id", "path"), "id").join(other, "other").select("path", "direction", "rel_type", "neighbour")


@R.add("recall_one_hop", f"SELECT h.query, h.path, l.direction, l.rel_type, o.path AS neighbour FROM ({_HYBRID}) h JOIN {SHOWN} n ON n.path = h.path JOIN {_DIRECTED} l ON l.id = n.id JOIN {SHOWN} o ON o.id = l.other WHERE h.position <= 5")
def _(s, d):
    return rt.neighbours(_hybrid(s, d, 5), shown(s, d), links(s, d))


@R.add("contradictions", f"SELECT DISTINCT n.path, o.path AS neighbour FROM {SHOWN} n JOIN {_DIRECTED} l ON l.id = n.id JOIN {SHOWN} o ON o.id = l.other WHERE l.rel_type = 'contradicts'")
def _(s, d):
    n = shown(s, d)
    return rt.contradictions(n.select(F.lit("all").alias("query"), "path"), n, links(s, d)).select("path", "neighbour")


@R.add("idf_table", f"SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM {SHOWN}) + 1.0) / (count(*) + 0.5)), 6) AS idf FROM (SELECT DISTINCT path, term FROM ({_POST})) GROUP BY term")
def _(s, d):
    from loam.functions import text as tx

    n = shown(s, d)
    df = tx.doc_freqs(rt.postings(n))
    return df.join(F.broadcast(n.agg(F.count(F.lit(1)).alias("n")))).select("term", "df", F.round(tx.idf(F.col("n"), F.col("df")), 6).alias("idf"))


_PROMPTS = "(SELECT CAST(item_id AS VARCHAR) AS query, prompt AS text, slug FROM eval_items)"
_COVER = f"""SELECT query, path, round(least(1.0, matched / qm, 0.5 + tm / qm), 9) AS lex_conf FROM (
SELECT *, CASE WHEN query_mass = 0 THEN 1.0 ELSE query_mass END AS qm, row_number() OVER (PARTITION BY query ORDER BY matched DESC, path) AS r FROM (
WITH post AS ({_POST}), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT t.query, t.term, ln(((SELECT count(*) FROM {SHOWN}) + 1.0) / (coalesce(df, 0) + 0.5)) AS w FROM (SELECT query, unnest(list_distinct({terms('text')})) AS term FROM {{queries}}) t LEFT JOIN df ON df.term = t.term),
qm AS (SELECT query, sum(w) AS query_mass FROM q GROUP BY query), ti AS (SELECT DISTINCT path, unnest({terms('title')}) AS term FROM {SHOWN})
SELECT q.query, p.path, query_mass, count(*) AS n, round(sum(w), 9) AS matched, sum(CASE WHEN ti.path IS NOT NULL THEN w ELSE 0 END) AS tm
FROM post p JOIN q ON q.term = p.term JOIN qm ON qm.query = q.query LEFT JOIN ti ON ti.path = p.path AND ti.term = p.term GROUP BY q.query, p.path, query_mass)) WHERE r <= 60 AND n >= 2 AND matched >= 7.0"""


def _prompts(s, d) -> DataFrame:
    return read_table(s, d, "eval_items").select(F.col("item_id").cast("string").alias("query"), F.col("prompt").alias("text"), "slug")


def _coverage(s, d, queries: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return rt.coverage(shown(s, d), queries, keep=keep)


@R.add("fts_or_coverage", f"SELECT query, path, lex_conf FROM ({_COVER.replace('{queries}', _PROMPTS)})")
def _(s, d):
    return _coverage(s, d, _prompts(s, d))


_CAND = f"""SELECT coalesce(a.query, b.query) AS query, coalesce(a.path, b.path) AS path, coalesce(a.lex_conf, 0.0) AS lex_conf, b.sim, {IMPORTANCE} AS importance,
(split_part(coalesce(a.query, b.query), '/', 2) = 'projects' AND split_part(coalesce(a.query, b.query), '/', 3) = split_part(n.path, '/', 3) AND starts_with(n.path, '/projects/')) AS in_project
FROM ({_COVER.replace('{queries}', NODE_QUERIES)}) a FULL JOIN ({_vec(10)}) b ON a.query = b.query AND a.path = b.path JOIN {SHOWN} n ON n.path = coalesce(a.path, b.path) WHERE n.path <> coalesce(a.query, b.query)"""


def _candidates(s, d) -> DataFrame:
    """Candidates for titles and vectors of the query nodes, without the node itself."""
    q, n = node_queries(s, d), shown(s, d)
    near = rt.vector_arm(n, q, 10, DIMS).join(n.select("path", "importance"), "path")
    arms = [df.filter("query != path") for df in (_coverage(s, d, q, ["importance"]), near)]
    slug = ps.project_slug
    return gate.merge_signals(*arms, ["importance"]).withColumn("importance", importance()).withColumn("in_project", F.coalesce(slug(F.col("query")) == slug(F.col("path")), F.lit(False))).select("query", "path", "lex_conf", "sim", "importance", "in_project")


@R.add("merge_candidates", f"SELECT query, path, lex_conf, sim, in_project FROM ({_CAND})")
def _(s, d):
    return _candidates(s, d).select("query", "path", "lex_conf", "sim", "in_project")


_FEAT = f"""SELECT *, coalesce(sim, 0.0) AS s, (sim IS NOT NULL AND sim = s1) AS sem_top, (lex_conf > 0 AND lex_conf = l1) AS lex_top,
CASE WHEN s1 IS NULL THEN 0.0 WHEN sim IS NOT NULL AND sim = s1 THEN sim - coalesce(s2, 0.0) ELSE coalesce(sim, 0.0) - s1 END AS sem_margin,
CASE WHEN lex_conf <= 0 THEN 0.0 WHEN lex_conf = l1 THEN lex_conf - coalesce(l2, 0.0) ELSE lex_conf - l1 END AS lex_margin
FROM (SELECT *, list_reverse_sort(list(sim) FILTER (sim IS NOT NULL) OVER w)[1] AS s1, list_reverse_sort(list(sim) FILTER (sim IS NOT NULL) OVER w)[2] AS s2, list_reverse_sort(list(lex_conf) FILTER (lex_conf > 0) OVER w)[1] AS l1, list_reverse_sort(list(lex_conf) FILTER (lex_conf > 0) OVER w)[2] AS l2 FROM ({_CAND}) WINDOW w AS (PARTITION BY query))"""
_W = gate.WEIGHTS
_PROB = f"SELECT query, path, importance, round(1.0 / (1.0 + exp(-greatest(-60.0, least(60.0, {_W['bias']} + {_W['sim']} * s + {_W['lex']} * lex_conf + {_W['sem_margin']} * sem_margin + {_W['lex_margin']} * lex_margin + {_W['sem_top']} * sem_top::INT + {_W['lex_top']} * lex_top::INT + {_W['both_top']} * (sem_top AND lex_top)::INT + {_W['importance']} * importance + {_W['in_project']} * coalesce(in_project, false)::INT)))), 9) AS confidence FROM ({_FEAT})"
_HITS = f"SELECT query, path, confidence FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, importance DESC, path) AS r FROM ({_PROB}) WHERE confidence >= {{t}} AND importance >= 0.5) WHERE r <= 1"


@R.add("margin_features", f"SELECT query, path, round(sem_margin, 9) AS sem_margin, round(lex_margin, 9) AS lex_margin, sem_top::INT::DOUBLE AS sem_top, lex_top::INT::DOUBLE AS lex_top FROM ({_FEAT})")
def _(s, d):
    f = gate.add_features(_candidates(s, d))
    return f.select("query", "path", F.round("f_sem_margin", 9).alias("sem_margin"), F.round("f_lex_margin", 9).alias("lex_margin"), F.col("f_sem_top").alias("sem_top"), F.col("f_lex_top").alias("lex_top"))


def _scored(s, d) -> DataFrame:
    return gate.learned_confidence(gate.add_features(_candidates(s, d)))


@R.add("gate_select", f"SELECT query, path, confidence FROM ({_HITS.replace('{t}', str(0.5))})")
def _(s, d):
    return gate.select_hits(_scored(s, d), 0.5).select("query", "path", "confidence")


@R.add("gate_threshold", f"SELECT query, path, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, importance DESC, path) AS r FROM (SELECT *, round(1.0 - (1.0 - lex_conf) * (1.0 - CASE WHEN sim IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (sim - 0.5) / (0.8 - 0.5))) END), 9) AS c FROM ({_CAND})) WHERE c >= 0.9 AND importance >= 0.5) WHERE r <= 1")
def _(s, d):
    return gate.select_hits(gate.threshold_confidence(_candidates(s, d)), 0.9).select("query", "path", "confidence")


@R.add("near_miss", f"SELECT query, path, confidence, CASE WHEN confidence < 0.5 THEN 'below threshold' ELSE 'importance' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, importance DESC, path) AS r FROM ({_PROB})) WHERE r = 1 AND query NOT IN (SELECT query FROM ({_HITS.replace('{t}', str(0.5))}))")
def _(s, d):
    return gate.near_miss(_scored(s, d), 0.5)


_GOLD = f"(SELECT q.path AS query, list(DISTINCT o.path) FILTER (o.path IS NOT NULL) AS e FROM (SELECT id, path FROM memory_nodes WHERE type = 'feedback' AND {LIVE}) q LEFT JOIN {_DIRECTED} l ON l.id = q.id LEFT JOIN {SHOWN} o ON o.id = l.other GROUP BY 1)"


def _gold(s, d) -> DataFrame:
    """What the links say should be found for the query nodes. Links of other nodes don't travel, unless there are more query nodes than can be sent to them."""
    q = materialize(nodes(s, d).filter((F.col("type") == "feedback") & live()).select(F.col("id"), F.col("path").alias("query")))
    o = shown(s, d).select(F.col("id").alias("other"), F.col("path").alias("p"))
    rows, n = read_table(s, d, "memory_links"), q.count()
    if n <= BROADCAST_ROWS:
        for end in ("from_id", "to_id"):
            rows = rows.join(F.broadcast(q.select(F.col("id").alias(f"_{end}")).distinct()), F.lower(end) == F.col(f"_{end}"), "left")
        rows = rows.filter("_from_id is not null or _to_id is not null").drop("_from_id", "_to_id")
    e = lookup_join(rt.directed(links_of(rows)), q, "id", rows=n).join(o, "other").groupBy("query").agg(F.collect_set("p").alias("expected"))
    return q.select("query").join(e, "query", "left").withColumn("acceptable", F.array().cast("array<string>"))


def _metrics(t: float) -> str:
    return f"""SELECT round(coalesce(count(*) FILTER (len(e) > 0 AND list_contains(e, path)) / nullif(count(*) FILTER (len(e) > 0), 0), 0.0), 9) AS recall, round(coalesce(count(*) FILTER (list_contains(e, path)) / nullif(count(path), 0), 1.0), 9) AS precision,
round(coalesce(count(*) FILTER (len(coalesce(e, [])) = 0 AND path IS NOT NULL) / nullif(count(*) FILTER (len(coalesce(e, [])) = 0), 0), 0.0), 9) AS false_positive_rate, round(count(path) / count(*), 9) AS injection_rate, CAST({t} AS DOUBLE) AS threshold
FROM {_GOLD} g LEFT JOIN ({_HITS.replace('{t}', str(t))}) h ON h.query = g.query"""


@R.add("param_sweep", " UNION ALL ".join(_metrics(t) for t in (0.2, 0.5, 0.8)))
def _(s, d):
    return gate.sweep(_gold(s, d), _scored(s, d), [0.2, 0.5, 0.8])


@R.add("frontier", " UNION ALL ".join(_metrics(t) for t in gate.FRONTIER))
def _(s, d):
    return gate.sweep(_gold(s, d), _scored(s, d))


_GRID = [gate.GateParams(max_hits=h, min_confidence=c, sim_full=f) for h in (1, 2) for c in (0.7, 0.9) for f in (0.8, 0.95)]


def _grid_sql(p: gate.GateParams) -> str:
    conf = f"round(1.0 - (1.0 - lex_conf) * (1.0 - CASE WHEN sim IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (sim - {p.sim_zero}) / ({p.sim_full} - {p.sim_zero}))) END), 9)"
    hits = f"SELECT query, path FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, importance DESC, path) AS r FROM (SELECT *, {conf} AS c FROM ({_CAND})) WHERE c >= {p.min_confidence} AND importance >= {p.min_importance}) WHERE r <= {p.max_hits}"
    return f"""SELECT CAST({p.max_hits} AS INTEGER) AS max_hits, CAST({p.min_confidence} AS DOUBLE) AS min_confidence, CAST({p.sim_full} AS DOUBLE) AS sim_full, round(coalesce(count(DISTINCT g.query) FILTER (len(e) > 0 AND list_contains(e, path)) / nullif(count(DISTINCT g.query) FILTER (len(e) > 0), 0), 0.0), 9) AS recall, round(coalesce(count(*) FILTER (list_contains(e, path)) / nullif(count(path), 0), 1.0), 9) AS precision,
round(coalesce(count(DISTINCT g.query) FILTER (len(coalesce(e, [])) = 0 AND path IS NOT NULL) / nullif(count(DISTINCT g.query) FILTER (len(coalesce(e, [])) = 0), 0), 0.0), 9) AS false_positive_rate, round(count(DISTINCT g.query) FILTER (path IS NOT NULL) / count(DISTINCT g.query), 9) AS injection_rate FROM {_GOLD} g LEFT JOIN ({hits}) h ON h.query = g.query"""


@R.add("param_grid", " UNION ALL ".join(map(_grid_sql, _GRID)))
def _(s, d):
    return gate.grid(_gold(s, d), materialize(_candidates(s, d)), _GRID).select("max_hits", "min_confidence", "sim_full", "recall", "precision", "false_positive_rate", "injection_rate")


@R.add("gate_failures", f"""WITH p AS MATERIALIZED ({_PROB}), h AS (SELECT query, path FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, importance DESC, path) AS r FROM p WHERE confidence >= 0.5 AND importance >= 0.5) WHERE r <= 1),
b AS (SELECT g.query, CASE WHEN len(coalesce(e, [])) > 0 AND (h.path IS NULL OR NOT list_contains(e, h.path)) THEN 'missed' WHEN h.path IS NOT NULL AND NOT list_contains(coalesce(e, []), h.path) THEN 'wrong' END AS kind FROM {_GOLD} g LEFT JOIN h ON h.query = g.query)
SELECT b.query, kind, c.path, c.confidence, c.position FROM b LEFT JOIN (SELECT query, path, confidence, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, importance DESC, path) AS position FROM p QUALIFY position <= 3) c ON c.query = b.query WHERE kind IS NOT NULL""")
def _(s, d):
    return gate.failures(_gold(s, d), _scored(s, d), 0.5)


@R.add("candidate_pool", f"SELECT query, path, confidence, position FROM (SELECT query, path, confidence, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, importance DESC, path) AS position FROM ({_PROB}) WHERE importance >= 0) WHERE position <= 10")
def _(s, d):
    return gate.candidate_pool(_scored(s, d)).select("query", "path", "confidence", F.col("position").cast("long").alias("position"))


@R.add("gate_fit")
def _(s, d):
    """(feature, weight) of the gate fitted on what the links say should be found."""
    model = gate.fit(gate.labelled(_gold(s, d), gate.add_features(_candidates(s, d))))
    return s.createDataFrame(list(model.weights.items()), "feature string, weight double")


@R.add("cross_validated")
def _(s, d):
    """The metrics of models that never saw the query they are judged on, in five folds."""
    gold = materialize(_gold(s, d))
    preds = gate.cross_validate(gold, gate.add_features(_candidates(s, d)), 5)
    return gate.evaluate(gold, gate.select_hits(preds, 0.5))


@R.add("trivial_prompts", f"SELECT CAST(item_id AS VARCHAR) AS query, (starts_with(trim(prompt), '/') AND NOT contains(trim(prompt), ' ')) OR len(list_distinct({terms('prompt')})) < 2 AS trivial FROM eval_items UNION ALL SELECT path, (starts_with(trim(slug), '/') AND NOT contains(trim(slug), ' ')) OR len(list_distinct({terms('slug')})) < 2 FROM memory_nodes WHERE slug IS NOT NULL")
def _(s, d):
    """Prompts, and the slugs of nodes as prompts, that ask for nothing."""
    from loam.functions import text as tx

    rows = _prompts(s, d).select("query", "text").unionByName(nodes(s, d).filter("slug is not null").select(F.col("path").alias("query"), F.col("slug").alias("text")))
    return rows.select("query", tx.trivial_prompt(F.col("text")).alias("trivial"))


@R.add("eval_metrics", f"SELECT * EXCLUDE (threshold) FROM ({_metrics(0.5)})")
def _(s, d):
    return gate.evaluate(_gold(s, d), gate.select_hits(_scored(s, d), 0.5))


@R.add("recommend", f"SELECT * FROM ({' UNION ALL '.join(_metrics(t) for t in (0.2, 0.5, 0.8))}) ORDER BY (precision >= 0.9)::INT DESC, recall DESC, precision DESC, false_positive_rate, threshold DESC LIMIT 1")
def _(s, d):
    return gate.recommend(gate.sweep(_gold(s, d), materialize(_scored(s, d)), [0.2, 0.5, 0.8]))


@R.add("folds", "SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) % 10 AS fold FROM eval_items")
def _(s, d):
    return gate.folds(read_table(s, d, "eval_items").select("item_id"), "item_id", 10).withColumn("fold", F.col("fold").cast("long"))


@R.add("never_used", "SELECT path FROM (SELECT '/projects/' || user_id || '/' || CAST(ts AS DATE) AS path, count(*) AS n, bool_or(event_type = 'purchase') AS u FROM events GROUP BY 1) WHERE n >= 3 AND NOT u")
def _(s, d):
    """Events of a user and day stand for the showings of a node."""
    e = read_table(s, d, "events").select(F.concat_ws("/", F.lit("/projects"), F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("path"), (F.col("event_type") == "purchase").alias("used"))
    return gate.never_used(e)


@R.add("usage_rank", f"""WITH post AS MATERIALIZED (SELECT path, unnest(list_distinct({terms(DOC)})) AS term FROM {SHOWN}), n AS (SELECT count(*) AS n FROM {SHOWN}), w AS MATERIALIZED (SELECT p.path, p.term, ln(((SELECT n FROM n) + 1.0) / (f.df + 0.5)) AS w FROM post p JOIN (SELECT term, count(*) AS df FROM post GROUP BY 1) f ON f.term = p.term), mass AS (SELECT path, sqrt(sum(w)) AS mass FROM w GROUP BY 1),
hit AS (SELECT query, arg_max(path, row(lex_conf, path)) AS path FROM ({_COVER.replace('{queries}', _PROMPTS)}) GROUP BY 1), r AS (SELECT h.query, h.path, i.passage AS reply, unnest(list_filter(list_distinct({terms('i.passage')}), lambda x: NOT list_contains({terms('i.prompt')}, x))) AS term FROM hit h JOIN eval_items i ON CAST(i.item_id AS VARCHAR) = h.query),
fit AS MATERIALIZED (SELECT r.query, w.path, round(sum(w.w) / any_value(mass.mass), 9) AS fit FROM r JOIN w ON w.term = r.term JOIN mass ON mass.path = w.path GROUP BY 1, 2), t AS (SELECT h.query, h.path, contains(coalesce(i.passage, ''), h.path) AS named, coalesce(fit.fit, 0.0) AS target FROM hit h JOIN eval_items i ON CAST(i.item_id AS VARCHAR) = h.query LEFT JOIN fit ON fit.query = h.query AND fit.path = h.path)
SELECT query, path, round(CASE WHEN named THEN 0.0 WHEN target > 0 THEN (SELECT count(*) FROM fit f WHERE f.query = t.query AND f.fit >= t.target) / (SELECT n FROM n) ELSE 1.0 END, 9) AS rank_share FROM t""")
def _(s, d):
    items = read_table(s, d, "eval_items").select(F.col("item_id").cast("string").alias("query"), "prompt", F.col("passage").alias("reply"))
    n = shown(s, d)
    hits = _coverage(s, d, _prompts(s, d)).groupBy("query").agg(F.max_by("path", F.struct("lex_conf", "path")).alias("path"))
    return rt.usage_rank(n, items.join(hits, "query"))


@R.add("fresh_search", f"SELECT path FROM memory_nodes WHERE {LIVE} AND list_has_all({terms(DOC)}, ['alte', 'puffer']) ORDER BY path LIMIT 30")
def _(s, d):
    from loam.functions import text as tx

    q = F.array(F.lit("alte"), F.lit("puffer"))
    n = nodes(s, d).filter(live() & fresh(NOW, include_expired=True))
    return n.filter(F.size(F.array_except(q, tx.lexemes(tx.document()))) == 0).select("path").orderBy("path").limit(30)


QUERIES, ORACLE = R.queries, R.sql
