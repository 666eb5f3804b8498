"""Queries over the tree: scans, predicates, projections, statistics, changes and replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import paths as ps
from loam.functions import text as tx
from loam.operators import consolidate, graph, mutate, stats, sync
from loam.operators.retrieval import digest, pack_skipping
from loam.plans.common import BRANCH, DOC, FRESH, IMPORTANCE, LIVE, NOW, SHOWN, SLUG, T, VISIBLE, Registry, nodes, shown, terms
from loam.session import read_table
from loam.visibility import days_since, fresh, importance, live, moment, visible

R = Registry()
ROOT = "/projects/oskxill"
TAG = "preference"


@R.add("scan_live_nodes", f"SELECT path, title, CAST(importance AS DOUBLE) AS importance FROM memory_nodes WHERE {VISIBLE} AND type <> 'category'")
def _(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).filter(visible(NOW, categories=False)).select("path", "title", F.col("importance").cast("double").alias("importance"))


@R.add("subtree", f"SELECT path, CAST(len(string_split(path, '/')) - 2 AS BIGINT) AS depth FROM memory_nodes WHERE {LIVE} AND (path = '{ROOT}' OR starts_with(path, '{ROOT}/'))")
def _(s, d):
    return nodes(s, d).filter(live() & ps.in_subtree(F.col("path"), ROOT)).select("path", ps.depth(F.col("path")).cast("long").alias("depth"))


@R.add("tag_lookup", f"SELECT path FROM memory_nodes WHERE {VISIBLE} AND list_contains(tags, '{TAG}')")
def _(s, d):
    return nodes(s, d).filter(visible(NOW) & F.array_contains("tags", TAG)).select("path")


@R.add("array_overlap", f"SELECT path FROM memory_nodes WHERE {LIVE} AND list_has_any(pin_triggers, ['start', 'compact'])")
def _(s, d):
    return nodes(s, d).filter(live() & F.arrays_overlap("pin_triggers", F.array(F.lit("start"), F.lit("compact")))).select("path")


@R.add("array_empty", "SELECT count(*) AS n, count(*) FILTER (len(coalesce(tags, [])) > 0) AS tagged, count(*) FILTER (len(coalesce(trigger_keywords, [])) = 0) AS no_keywords FROM memory_nodes")
def _(s, d):
    size = lambda c: F.size(F.coalesce(c, F.array()))
    return nodes(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(size("tags") > 0).alias("tagged"), F.count_if(size("trigger_keywords") == 0).alias("no_keywords"))


@R.add("substring", f"SELECT path FROM memory_nodes WHERE {VISIBLE} AND (contains(lower(coalesce(title, '')), 'puffer') OR contains(lower(coalesce(body, '')), 'puffer'))")
def _(s, d):
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("puffer"))
    return nodes(s, d).filter(visible(NOW) & (has("title") | has("body"))).select("path")


@R.add("fts_and", f"SELECT path FROM (SELECT path, {terms(DOC)} AS w FROM memory_nodes WHERE {VISIBLE}) WHERE list_has_all(w, ['alte', 'puffer'])")
def _(s, d):
    q = F.array(F.lit("alte"), F.lit("puffer"))
    return nodes(s, d).filter(visible(NOW) & (F.size(F.array_except(q, tx.lexemes(tx.document()))) == 0)).select("path")


@R.add("fts_or_or_substring", f"SELECT count(*) AS n FROM (SELECT {terms(DOC)} AS w, title, body FROM memory_nodes WHERE {LIVE} AND origin = 'extracted') WHERE list_has_any(w, ['buffer', 'puffer']) OR contains(lower(coalesce(body, '')), 'top_k')")
def _(s, d):
    n = nodes(s, d).filter(live() & (F.col("origin") == "extracted"))
    hit = F.arrays_overlap(tx.lexemes(tx.document()), F.array(F.lit("buffer"), F.lit("puffer"))) | F.contains(F.lower(F.coalesce("body", F.lit(""))), F.lit("top_k"))
    return n.filter(hit).agg(F.count(F.lit(1)).alias("n"))


@R.add("regex_match", r"SELECT path FROM memory_nodes WHERE regexp_matches(body, '(?i)\b(gestern|yesterday)\b')")
def _(s, d):
    return nodes(s, d).filter(F.col("body").rlike(r"(?iU)\b(gestern|yesterday)\b")).select("path")


@R.add("json_config", "SELECT id, name, CAST(json_extract_string(config, '$.log_retention_days') AS BIGINT) AS days, json_extract_string(config, '$.auto_extract') AS auto FROM projects")
def _(s, d):
    c = lambda k: F.get_json_object("config", f"$.{k}")
    return read_table(s, d, "projects").select("id", "name", c("log_retention_days").cast("long").alias("days"), c("auto_extract").alias("auto"))


@R.add("expired", f"SELECT path FROM memory_nodes WHERE {LIVE} AND origin = 'curated' AND valid_until < {T} - INTERVAL 14 DAYS")
def _(s, d):
    return consolidate.expired(nodes(s, d).filter(live() & (F.col("origin") == "curated")), NOW).select("path")


@R.add("stale", f"SELECT path FROM memory_nodes WHERE {LIVE} AND origin = 'curated' AND round(CAST(importance AS DOUBLE), 6) <= 0.4 AND len(coalesce(pin_triggers, [])) = 0 AND valid_until IS NULL AND updated_at < {T} - INTERVAL 180 DAYS")
def _(s, d):
    return consolidate.stale(nodes(s, d).filter(live() & (F.col("origin") == "curated")), NOW).select("path")


@R.add("paths", f"SELECT path, CASE WHEN regexp_replace(path, '/[^/]*$', '') <> '' THEN regexp_replace(path, '/[^/]*$', '') END AS parent, {SLUG} AS slug_of, {BRANCH} AS branch, (starts_with(path, '/projects/') AND len(string_split(path, '/')) >= 4 AND NOT contains(path || '/', '//')) AS pinnable FROM memory_nodes")
def _(s, d):
    p = F.col("path")
    return nodes(s, d).select("path", ps.parent_path(p).alias("parent"), ps.project_slug(p).alias("slug_of"), ps.branch(p).alias("branch"), ps.pinnable(p).alias("pinnable"))


@R.add("slugify", "SELECT path, CASE WHEN s = '' THEN 'turn' ELSE s END AS slugged, substr(sha1(coalesce(body, '')), 1, 8) AS digest FROM (SELECT path, body, substr(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS s FROM memory_nodes)")
def _(s, d):
    return nodes(s, d).select("path", tx.slugify(F.col("title")).alias("slugged"), F.substring(F.sha1(F.coalesce("body", F.lit(""))), 1, 8).alias("digest"))


@R.add("snippets", "SELECT path, substr(coalesce(body, ''), 1, 160) AS snippet, CASE WHEN length(body) > 600 THEN rtrim(substr(body, 1, 600), ' ') || ' …' ELSE body END AS short, CAST(round_even(length(coalesce(body, '')) / 3.7, 0) AS BIGINT) AS tokens FROM memory_nodes")
def _(s, d):
    b = F.col("body")
    return nodes(s, d).select("path", tx.snippet(b).alias("snippet"), tx.shorten(b, 600).alias("short"), tx.approx_tokens(F.length(F.coalesce(b, F.lit("")))).alias("tokens"))


_LINE = "coalesce(list_filter(list_transform(string_split_regex(coalesce(body, ''), '\\r\\n|\\n|\\r'), lambda x: trim(regexp_replace(x, '^\\s*(?:[-*>]+|\\d+\\.)\\s+|[*_`]+', '', 'g'))), lambda x: length(x) > 0 AND NOT starts_with(x, '#'))[1], '')"
_HOOK = f"(SELECT *, CASE WHEN length(h) > 120 THEN rtrim(substr(h, 1, 119)) || '…' ELSE h END AS hook FROM (SELECT *, CASE WHEN regexp_extract(l, '^(.*?[.!?])(?:\\s|$)', 1) = '' THEN l ELSE regexp_extract(l, '^(.*?[.!?])(?:\\s|$)', 1) END AS h FROM (SELECT *, {_LINE} AS l FROM {{source}})))"


@R.add("first_sentences", f"SELECT path, hook FROM {_HOOK.format(source='memory_nodes')}")
def _(s, d):
    return nodes(s, d).select("path", tx.first_sentence(F.col("body")).alias("hook"))


@R.add("highlights", f"SELECT path, regexp_replace(title, '(?i)\\b(puffer|index|buffer)\\b', '«\\1»', 'g') AS marked FROM {SHOWN}")
def _(s, d):
    return shown(s, d).select("path", tx.highlight(F.col("title"), ["puffer", "index", "buffer"]).alias("marked"))


_PROSE = "regexp_replace(coalesce(body, ''), '```.*?```|`[^`\\n]*`', ' ', 'gs')"
_DAYS = "CASE lower(w) WHEN 'vorgestern' THEN -2 WHEN 'gestern' THEN -1 WHEN 'yesterday' THEN -1 WHEN 'heute' THEN 0 WHEN 'today' THEN 0 WHEN 'tomorrow' THEN 1 WHEN 'morgen' THEN 1 ELSE 2 END"
_LOCAL = "CAST(timezone('Europe/Berlin', {0} AT TIME ZONE 'UTC') AS DATE)"
_DATED = f"(SELECT path, string_agg(d, ',' ORDER BY d) AS dates FROM (SELECT DISTINCT path, w || '=' || CAST(day + CAST({_DAYS} AS INTEGER) AS VARCHAR) AS d FROM (SELECT path, {_LOCAL.format('created_at')} AS day, unnest(list_concat(regexp_extract_all({_PROSE}, '(?i)\\b(?:vorgestern|gestern|yesterday|heute|today|tomorrow)\\b'), list_filter(regexp_extract_all({_PROSE}, '\\p{{{{L}}}}+(?:\\s*früh)?'), lambda x: x IN ('morgen', 'übermorgen')))) AS w FROM {{source}} WHERE {_LOCAL.format('created_at')} = {_LOCAL.format('updated_at')})) GROUP BY 1)"


@R.add("titles", "SELECT path, CASE WHEN length(l) > 120 THEN substr(l, 1, 117) || '...' ELSE l END AS title_of FROM (SELECT path, coalesce(list_filter(list_transform(string_split_regex(coalesce(body, ''), '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: x <> '')[1], '') AS l FROM memory_nodes)")
def _(s, d):
    return nodes(s, d).select("path", tx.title_of(F.col("body")).alias("title_of"))


@R.add("tag_lists", "SELECT path, array_to_string(list_filter(t, lambda x, i: list_position(list_transform(t, lambda y: lower(y)), lower(x)) = i), '|') AS tags FROM (SELECT path, list_concat(list_filter(list_transform(string_split(coalesce(array_to_string(tags, ', ') || ',' || upper(tags[1]), ''), ','), lambda x: trim(x)), lambda x: x <> ''), ['Review', 'kept']) AS t FROM memory_nodes)")
def _(s, d):
    """The tags of each node as one text, its first one repeated in capitals, read back with two forced ones."""
    text = F.concat(F.array_join("tags", ", "), F.lit(","), F.upper(F.try_element_at("tags", F.lit(1))))
    return nodes(s, d).select("path", F.array_join(tx.tag_list(text, ["Review", "kept"]), "|").alias("tags"))


@R.add("headlines", f"SELECT path, list_contains(string_split_regex(lower(hl), '[^a-z]+'), 'puffer') AS hit, len(string_split(hl, ' ')) <= 25 AS short FROM (SELECT path, coalesce(title, '') || ' ' || coalesce(body, '') AS hl0, CASE WHEN regexp_matches({DOC}, '(?i)\\bpuffer\\b') THEN 'puffer' ELSE '' END AS hl FROM {SHOWN})")
def _(s, d):
    """Whether the words around the first hit hold it, and are few."""
    h = tx.headline(tx.document(), ["puffer"])
    return shown(s, d).select("path", F.contains(F.lower(h), F.lit("«puffer»")).alias("hit"), (F.size(F.split(h, " ")) <= 25).alias("short"))


@R.add("relative_dates", f"SELECT path, dates FROM {_DATED.format(source='memory_nodes')}")
def _(s, d):
    return consolidate.dated(nodes(s, d)).withColumn("dates", F.array_join("dates", ","))


@R.add("fingerprints", "SELECT path, substr(sha256('stale|' || array_to_string(list_sort([path, slug]), '|') || '|' || strftime(updated_at, '%Y-%m-%d')), 1, 32) AS fingerprint FROM memory_nodes WHERE slug IS NOT NULL")
def _(s, d):
    return nodes(s, d).filter("slug is not null").select("path", consolidate.fingerprint(F.lit("stale"), F.array("path", "slug"), F.date_format("updated_at", "yyyy-MM-dd")).alias("fingerprint"))


@R.add("corpus_stats", f"SELECT count(*) AS n, count(*) FILTER (origin = 'curated') AS curated, count(*) FILTER (origin <> 'curated') AS extracted, count(*) FILTER (len(embedding) > 0) AS embedded, count(*) FILTER (len(pin_triggers) > 0) AS pinned, CAST(coalesce(sum(length(coalesce(body, ''))) FILTER (origin = 'curated'), 0) AS BIGINT) AS chars, CAST(round_even(coalesce(sum(length(coalesce(body, ''))) FILTER (origin = 'curated'), 0) / 3.7, 0) AS BIGINT) AS tokens, count(DISTINCT {SLUG}) AS projects FROM memory_nodes WHERE {LIVE} AND type <> 'category'")
def _(s, d):
    return stats.corpus(nodes(s, d), NOW)


@R.add("quality_bands", f"""SELECT count(*) FILTER (i >= 0.7) AS high, count(*) FILTER (i >= 0.4 AND i < 0.7) AS middle, count(*) FILTER (i < 0.4) AS low,
count(*) FILTER (created_at >= {T} - INTERVAL 7 DAYS) AS created_7d, count(*) FILTER (created_at >= {T} - INTERVAL 30 DAYS) AS created_30d, count(*) FILTER (updated_at >= {T} - INTERVAL 7 DAYS) AS updated_7d, count(*) FILTER (updated_at >= {T} - INTERVAL 30 DAYS) AS updated_30d,
count(*) FILTER (coalesce(access_count, 0) = 0) AS never_accessed, count(*) FILTER (updated_at < {T} - INTERVAL 180 DAYS) AS stale, count(*) FILTER (valid_until < {T}) AS expired, count(*) FILTER (length(coalesce(body, '')) > 2000) AS oversized, round(avg(length(coalesce(body, ''))), 6) AS avg_chars
FROM (SELECT *, round(CAST(importance AS DOUBLE), 6) AS i FROM memory_nodes WHERE {LIVE} AND origin = 'curated' AND type <> 'category')""")
def _(s, d):
    return stats.quality(nodes(s, d), NOW)


@R.add("branch_overview", f"SELECT {BRANCH} AS branch, count(*) AS n, max(updated_at) AS last_update FROM memory_nodes WHERE {VISIBLE} GROUP BY 1")
def _(s, d):
    return stats.branches(nodes(s, d).filter(visible(NOW)))


@R.add("counts_by_type", "SELECT type, origin, provenance, count(*) AS n FROM memory_nodes GROUP BY ALL")
def _(s, d):
    return stats.counts_by(nodes(s, d), "type", "origin", "provenance")


@R.add("growth_monthly", f"SELECT strftime(date_trunc('month', created_at), '%Y-%m') AS month, count(*) AS n FROM memory_nodes WHERE date_trunc('month', created_at) >= date_trunc('month', {T}) - INTERVAL 5 MONTHS GROUP BY 1")
def _(s, d):
    return stats.monthly(nodes(s, d), "created_at", NOW)


_ACTIVITY = f"""SELECT CAST(g.day AS DATE) AS day, coalesce(c.n, 0) AS created, coalesce(u.n, 0) AS updated FROM (SELECT CAST({T} AS DATE) - CAST(i AS INTEGER) AS day FROM range(365) t(i)) g
LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM memory_nodes WHERE {LIVE} AND origin = 'curated' GROUP BY 1) c ON c.day = g.day
LEFT JOIN (SELECT CAST(updated_at AS DATE) AS day, count(*) AS n FROM memory_nodes WHERE {LIVE} AND origin = 'curated' AND CAST(updated_at AS DATE) > CAST(created_at AS DATE) GROUP BY 1) u ON u.day = g.day"""


def _activity(s: SparkSession, d: str) -> DataFrame:
    return stats.activity(nodes(s, d).filter(live() & (F.col("origin") == "curated")), NOW)


R.add("activity_series", _ACTIVITY)(_activity)


@R.add("streaks", f"SELECT min(day) AS start, count(*) AS length FROM (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS i FROM ({_ACTIVITY}) WHERE created > 0) GROUP BY i")
def _(s, d):
    return stats.streaks(_activity(s, d).select("day", F.col("created").alias("n")))


@R.add("quantile_levels", f"""WITH a AS (SELECT day, created AS n FROM ({_ACTIVITY})), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS r, count(*) OVER () AS c FROM a WHERE n > 0),
q AS (SELECT max(n) FILTER (r = floor(c * 0.3)) AS q0, max(n) FILTER (r = floor(c * 0.6)) AS q1, max(n) FILTER (r = floor(c * 0.85)) AS q2 FROM r)
SELECT day, n, CASE WHEN n <= 0 THEN 0 WHEN n <= q0 THEN 1 WHEN n <= q1 THEN 2 WHEN n <= q2 THEN 3 ELSE 4 END AS level FROM a, q""")
def _(s, d):
    return stats.levels(_activity(s, d).select("day", F.col("created").alias("n")))


@R.add("newest_n_per_group", f"SELECT slug_of, path FROM (SELECT {SLUG} AS slug_of, path, row_number() OVER (PARTITION BY {SLUG} ORDER BY created_at DESC, path) AS r FROM memory_nodes WHERE origin = 'extracted' AND {LIVE} AND {SLUG} IS NOT NULL) WHERE r <= 3")
def _(s, d):
    from loam.operators.retrieval import top

    n = nodes(s, d).filter((F.col("origin") == "extracted") & live()).withColumn("slug_of", ps.project_slug(F.col("path"))).filter("slug_of is not null")
    return top(n, ["slug_of"], [F.desc("created_at"), F.col("path")], 3).select("slug_of", "path")


@R.add("rank_score", f"SELECT path, round({IMPORTANCE} + least(coalesce(access_count, 0), 20) / 40.0 + CASE WHEN updated_at >= {T} - INTERVAL 30 DAYS THEN 0.2 ELSE 0 END, 9) AS score, round(greatest((epoch_us({T}) - epoch_us(updated_at)) / 86400000000.0, 0), 6) AS days FROM memory_nodes WHERE {LIVE} ORDER BY score DESC, path LIMIT 50")
def _(s, d):
    score = F.round(importance() + F.least(F.coalesce("access_count", F.lit(0)), F.lit(20)) / 40.0 + F.when(F.col("updated_at") >= moment(NOW) - F.expr("INTERVAL 30 DAYS"), 0.2).otherwise(0.0), 9)
    return nodes(s, d).filter(live()).select("path", score.alias("score"), F.round(days_since("updated_at", NOW), 6).alias("days")).orderBy(F.desc("score"), "path").limit(50)


_SCORE = f"round({IMPORTANCE} + least(coalesce(access_count, 0), 20) / 40.0 + CASE WHEN updated_at >= {T} - INTERVAL 30 DAYS THEN 0.2 ELSE 0 END, 9)"


@R.add("digest", f"SELECT project, position, path, chars FROM (SELECT *, row_number() OVER w AS position, sum(chars + 1) OVER (PARTITION BY project ORDER BY score DESC, path ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT {SLUG} AS project, path, {_SCORE} AS score, length(path || ' ' || hook) AS chars FROM {_HOOK.format(source=SHOWN)} WHERE {SLUG} IS NOT NULL) WINDOW w AS (PARTITION BY project ORDER BY score DESC, path)) WHERE run <= 5600")
def _(s, d):
    return digest(_projects(s, d), 8000, 0.7).withColumn("position", F.col("position").cast("long"))


def _projects(s: SparkSession, d: str) -> DataFrame:
    """Shown nodes of projects, with project and recent."""
    return shown(s, d).withColumn("project", ps.project_slug(F.col("path"))).filter("project is not null").withColumn("recent", F.col("updated_at") >= moment(NOW) - F.expr("INTERVAL 30 DAYS"))


@R.add("pack_skipping", f"""WITH RECURSIVE o AS MATERIALIZED (SELECT {SLUG} AS project, path, length(coalesce(body, '')) AS n, row_number() OVER (PARTITION BY {SLUG} ORDER BY {_SCORE} DESC, path) AS r FROM {SHOWN} WHERE {SLUG} IS NOT NULL),
f AS (SELECT project, path, r, CASE WHEN n <= 24000 THEN n ELSE 0 END AS used, n <= 24000 AS fits FROM o WHERE r = 1 UNION ALL SELECT o.project, o.path, o.r, f.used + CASE WHEN f.used + o.n <= 24000 THEN o.n ELSE 0 END, f.used + o.n <= 24000 FROM f JOIN o ON o.project = f.project AND o.r = f.r + 1)
SELECT project, path FROM f WHERE fits""")
def _(s, d):
    return pack_skipping(_projects(s, d), 24000)


@R.add("parent_backfill", "SELECT c.path, p.id AS parent_id FROM memory_nodes c LEFT JOIN memory_nodes p ON p.path = regexp_replace(c.path, '/[^/]*$', '')")
def _(s, d):
    return sync.backfill_parents(nodes(s, d))


@R.add("missing_ancestors", "SELECT DISTINCT a.path FROM (SELECT unnest(list_transform(range(2, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path FROM memory_nodes WHERE type <> 'category') a WHERE a.path NOT IN (SELECT path FROM memory_nodes WHERE type <> 'category')")
def _(s, d):
    """With the categories left out, so that something is missing."""
    return mutate.missing_ancestors(nodes(s, d).filter("type != 'category'"))


@R.add("subtree_totals", "SELECT a.path, count(*) AS below FROM (SELECT unnest(list_transform(range(2, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path FROM memory_nodes) a WHERE a.path IN (SELECT path FROM memory_nodes) GROUP BY 1")
def _(s, d):
    return graph.subtree_totals(nodes(s, d))


@R.add("nearest_ancestor", "SELECT n.path, (SELECT arg_max(p.path, length(p.path)) FROM memory_nodes p WHERE starts_with(n.path, p.path || '/')) AS ancestor FROM memory_nodes n")
def _(s, d):
    return graph.nearest_ancestor(nodes(s, d))


@R.add("layout_groups", f"SELECT {BRANCH} AS grp, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {BRANCH}) AS position FROM memory_nodes WHERE {LIVE} GROUP BY 1")
def _(s, d):
    return graph.layout_groups(nodes(s, d).filter(live()))


@R.add("subtree_tombstone", f"SELECT path, CASE WHEN {LIVE} AND (path = '{ROOT}' OR starts_with(path, '{ROOT}/')) THEN {T} ELSE deleted_at END AS deleted_at FROM memory_nodes")
def _(s, d):
    return mutate.tombstone_subtree(nodes(s, d), ROOT, NOW).select("path", "deleted_at")


@R.add("prune_extracted", f"SELECT path FROM (SELECT path, valid_until, {SLUG} AS g, row_number() OVER (PARTITION BY {SLUG} ORDER BY created_at DESC, path) AS r FROM memory_nodes WHERE {LIVE} AND origin = 'extracted') WHERE (r > 5 AND g IS NOT NULL) OR valid_until < {T}")
def _(s, d):
    n = nodes(s, d)
    return mutate.prune_extracted(n.filter(live()), NOW, keep=5).filter("deleted_at is not null").select("path")


@R.add("count_access", "SELECT path, access_count + CASE WHEN type = 'user' THEN 1 ELSE 0 END AS access_count FROM memory_nodes")
def _(s, d):
    n = nodes(s, d)
    return mutate.count_access(n, n.filter("type = 'user'").select("path", moment(NOW).alias("at"))).select("path", "access_count")


def _replicas(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from loam.operators.retrieval import top

    remote = top(read_table(s, d, "memory_nodes_remote"), ["path"], [F.desc("updated_at"), F.col("id")], 1)
    return nodes(s, d), remote


_REMOTE = "(SELECT * FROM memory_nodes_remote QUALIFY row_number() OVER (PARTITION BY path ORDER BY updated_at DESC, id) = 1)"
_COLUMNS = ("title", "body", "tags", "importance", "deleted_at")


@R.add("upsert_revive", f"SELECT coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NOT NULL THEN r.title ELSE l.title END AS title, CASE WHEN r.path IS NOT NULL THEN coalesce(r.provenance, l.provenance) ELSE l.provenance END AS provenance, CASE WHEN l.path IS NOT NULL THEN l.created_at ELSE r.created_at END AS created_at FROM memory_nodes l FULL JOIN {_REMOTE} r ON l.path = r.path")
def _(s, d):
    local, remote = _replicas(s, d)
    changes = remote.select("path", "title", "provenance", "created_at", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    return mutate.upsert(local, changes, "path", keep_if_null=["provenance"], keep_old=["created_at"]).select("path", "title", "provenance", "created_at")


@R.add("sync_plan", f"SELECT coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'push' WHEN l.path IS NULL THEN 'pull' WHEN l.updated_at > r.updated_at THEN 'push' WHEN r.updated_at > l.updated_at THEN 'pull' ELSE 'keep' END AS action FROM memory_nodes l FULL JOIN {_REMOTE} r ON l.path = r.path")
def _(s, d):
    return sync.plan(*_replicas(s, d), ["path"])


@R.add("lww_merge", f"SELECT coalesce(l.path, r.path) AS path, CASE WHEN l.path IS NULL OR r.updated_at > l.updated_at THEN r.title ELSE l.title END AS title, CASE WHEN l.path IS NULL OR r.updated_at > l.updated_at THEN r.updated_at ELSE l.updated_at END AS updated_at, CASE WHEN l.path IS NULL THEN r.created_at ELSE l.created_at END AS created_at FROM memory_nodes l FULL JOIN {_REMOTE} r ON l.path = r.path")
def _(s, d):
    return sync.merge(*_replicas(s, d), ["path"], ["title", "updated_at", "created_at"], insert_only=["created_at"])


@R.add("sync_conflicts", f"""SELECT l.path, CASE WHEN l.updated_at >= r.updated_at THEN 'local' ELSE 'remote' END AS winner FROM memory_nodes l JOIN {_REMOTE} r ON l.path = r.path
WHERE l.updated_at > TIMESTAMP '2025-06-01' AND r.updated_at > TIMESTAMP '2025-06-01' AND (l.title IS DISTINCT FROM r.title OR l.body IS DISTINCT FROM r.body OR coalesce(l.tags, []) IS DISTINCT FROM coalesce(r.tags, []) OR l.deleted_at IS DISTINCT FROM r.deleted_at
OR NOT (l.importance IS NOT DISTINCT FROM r.importance OR coalesce(abs(l.importance - r.importance) <= 0.0001, false)))""")
def _(s, d):
    return sync.conflicts(*_replicas(s, d), ["path"], _COLUMNS, "2025-06-01 00:00:00")


@R.add("delta_by_tag", f"SELECT path FROM memory_nodes WHERE {LIVE} AND ((list_has_any(coalesce(tags, []), ['infra', 'idea']) AND updated_at > TIMESTAMP '2026-01-01') OR list_has_any(coalesce(tags, []), ['review']))")
def _(s, d):
    return sync.delta(nodes(s, d), ["infra", "idea"], "2026-01-01 00:00:00", ["review"])  .select("path")


@R.add("incoming_paths", "SELECT path, CASE WHEN starts_with(path, '/') AND NOT contains(path || '/', '//') THEN '/links/peer' || path END AS incoming FROM memory_nodes")
def _(s, d):
    return nodes(s, d).select("path", ps.incoming_path("/links/peer", F.col("path")).alias("incoming"))


@R.add("markdown_export", f"SELECT path, '---\ntitle: ' || regexp_replace(coalesce(title, ''), '[\\r\\n]+', ' ', 'g') || '\ntype: ' || coalesce(type, 'note') || '\nimportance: ' || printf('%.2f', coalesce(CAST(importance AS DOUBLE), 0.5)) || '\n---\n\n' || coalesce(body, '') || '\n' AS text FROM memory_nodes WHERE {LIVE} AND origin = 'curated' AND NOT contains(path || '/', '//')")
def _(s, d):
    from loam.sources.files import markdown

    return markdown(nodes(s, d))


@R.add("session_hints", f"SELECT {SLUG} AS project, count(*) AS n, max(updated_at) AS last_change, count(*) FILTER (len(pin_triggers) > 0) AS pinned FROM {SHOWN} WHERE {SLUG} IS NOT NULL GROUP BY 1")
def _(s, d):
    n = shown(s, d).withColumn("project", ps.project_slug(F.col("path"))).filter("project is not null")
    return n.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("last_change"), F.count_if(F.size("pin_triggers") > 0).alias("pinned"))


@R.add("fresh_only", f"SELECT count(*) AS n, count(*) FILTER ({FRESH}) AS fresh FROM memory_nodes")
def _(s, d):
    return nodes(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(fresh(NOW)).alias("fresh"))


QUERIES, ORACLE = R.queries, R.sql
