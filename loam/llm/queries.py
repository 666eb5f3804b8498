"""Queries on training data, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.knn import knn, neighbour_pairs
from loam.llm.language import languages, wrong_labels
from loam.llm.leakage import leak_report, leaked_items, leaks_by_field
from loam.llm.mixing import Mix, mix_sources
from loam.llm.neardup import expand_pairs, groups, near_duplicates
from loam.llm.splitting import oversized, split_documents
from loam.session import read_table


def _near(spark: SparkSession, d: str):
    return near_duplicates(read_table(spark, d, "memory_nodes"), "id", ["title", "body"], threshold=0.5, n=3, min_words=20)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return expand_pairs(_near(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups(_near(spark, d))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    nodes = read_table(spark, d, "memory_nodes").filter("type is null or type != 'category'")
    return languages(nodes, read_table(spark, d, "node_langs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = wrong_labels(_languages(spark, d), read_table(spark, d, "node_langs"))
    return found.select(F.col("id").alias("node_id"), "seg_no", "lang").distinct()


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).withColumnRenamed("id", "node_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_pairs(knn(read_table(spark, d, "memory_nodes"), "id", "embedding", dims=384, k=5, ties=1e-6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return leak_report(leaks_by_field(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))).withColumnRenamed("item", "item_id")


def _mix(spark: SparkSession, d: str) -> Mix:
    return mix_sources(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).rows


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report


def p7_bounds(spark: SparkSession, d: str) -> DataFrame:
    """(source, n_docs, over, gaps): of each mixed source its records, how many were used more often than allowed, and how many whose copies aren't numbered 1, 2, ..."""
    m = _mix(spark, d)
    used = m.rows.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy_no").alias("last"), F.countDistinct("copy_no").alias("numbers"))
    report = m.report.filter("target_share > 0 and max_repeats > 0 and n_docs > 0").select("source", "n_docs", "max_repeats")
    rows = report.join(used, "source", "left").groupBy("source", "n_docs").agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("over"), F.count_if((F.col("n") != F.col("last")) | (F.col("n") != F.col("numbers"))).alias("gaps"))
    return rows


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """(source, met): whether a source's tokens are within its largest record of its share of the total, or all its records are used as often as allowed."""
    report = _mix(spark, d).report.filter("target_share > 0 and max_repeats > 0 and n_docs > 0")
    total = report.agg(F.sum("target_share").alias("shares"), F.sum("mixed_tokens").alias("tokens"))
    near = F.abs(F.col("mixed_tokens") - F.col("target_share") / F.col("shares") * F.col("tokens")) <= F.col("largest") + 0.01 * F.col("tokens")
    return report.join(F.broadcast(total)).select("source", (near | (F.col("mixed_tokens") == F.col("source_tokens") * F.col("max_repeats"))).alias("met"))


def p8_cover(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n_chars, covered, under): whether the pieces of a text follow each other without a gap from its first to its last character, and hold at most 1,000 tokens each."""
    w = Window.partitionBy("doc_id").orderBy("piece_no")
    p = p8_pieces(spark, d).filter("piece != ''").select("doc_id", "piece_no", "n_pieces", "begin", "end", "n_tokens", F.lag("end").over(w).alias("before"), F.lag("begin").over(w).alias("previous"))
    whole = F.when(F.col("piece_no") == 0, F.col("begin") == 0).otherwise((F.col("begin") <= F.col("before")) & (F.col("begin") > F.col("previous")) & (F.col("end") > F.col("before")))
    return p.groupBy("doc_id").agg(F.max("end").alias("n_chars"), (F.bool_and(whole) & (F.count(F.lit(1)) == F.max("n_pieces"))).alias("covered"), F.bool_and(F.col("n_tokens") <= 1000).alias("under"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized(split_documents(read_table(spark, d, "documents")))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(read_table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_segments": p2_segments, "p5_found": p5_found, "p6_found": p6_found, "p6_report": p6_report, "p7_mix": p7_mix, "p7_report": p7_report, "p7_bounds": p7_bounds, "p7_shares": p7_shares, "p8_cover": p8_cover, "p8_found": p8_found, "p8_pieces": p8_pieces}

_P6 = """
WITH i AS (SELECT item_id, field, list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM (SELECT item_id, 'prompt' AS field, prompt AS t FROM eval_items UNION ALL SELECT item_id, 'passage', passage FROM eval_items)),
ir AS (SELECT DISTINCT item_id, field, unnest(list_transform(range(1, len(ws) - 12), lambda i: array_to_string(ws[i:i + 13], ' '))) AS run FROM i WHERE len(ws) >= 14),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
dr AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 12), lambda i: array_to_string(ws[i:i + 13], ' '))) AS run FROM d WHERE len(ws) >= 14)
SELECT DISTINCT doc_id, item_id, field FROM dr JOIN ir ON dr.run = ir.run
"""

_NAME = "regexp_replace(lower(trim({0})), '[\\s-]+', '_', 'g')"
_MIXED = f"(SELECT d.source, count(*) AS n_docs FROM (SELECT {_NAME.format('source')} AS source FROM documents WHERE text <> '') d JOIN (SELECT {_NAME.format('source')} AS source FROM mix_targets GROUP BY 1 HAVING max(target_share) > 0 AND max(max_repeats) > 0) t ON t.source = d.source GROUP BY 1)"

ORACLE = {
    "p7_bounds": f"SELECT source, n_docs, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS gaps FROM {_MIXED}",
    "p7_shares": f"SELECT source, true AS met FROM {_MIXED}",
    "p8_cover": "SELECT doc_id, length(text) AS n_chars, true AS covered, true AS under FROM documents WHERE text <> ''",
    "p1_groups": """
WITH RECURSIVE w AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM memory_nodes),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]))) AS gram FROM w WHERE len(ws) >= 20),
c AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY s) AS class_id FROM (SELECT id, list_sort(list(gram)) AS s FROM g GROUP BY id)),
h AS MATERIALIZED (SELECT g.* FROM g WHERE id IN (SELECT class_id FROM c)), n AS (SELECT id, count(*) AS n FROM h GROUP BY id),
s AS (SELECT a.id AS a, b.id AS b, count(*) AS s FROM h a JOIN h b ON a.gram = b.gram AND a.id < b.id GROUP BY 1, 2),
p AS MATERIALIZED (SELECT a, b FROM s JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 2 * s >= x.n + y.n - s), e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), k AS (SELECT a, min(b) AS group_id FROM r GROUP BY 1), l AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1)
SELECT m.id, coalesce(c.class_id, m.id) AS class_id, coalesce(k.group_id, c.class_id, m.id) AS group_id, coalesce(l.n_links, 0) AS n_links FROM (SELECT DISTINCT id FROM memory_nodes) m LEFT JOIN c ON c.id = m.id LEFT JOIN k ON k.a = c.class_id LEFT JOIN l ON l.a = c.class_id
""",
    "p1_found": """
WITH w AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM memory_nodes),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]))) AS gram FROM w WHERE len(ws) >= 20),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
s AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS s FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM s JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * s >= x.n + y.n - s
""",
    "p5_found": """
WITH u AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM memory_nodes WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.e, b.e) AS s FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC) AS rn FROM s),
k AS (SELECT x, min(s) AS kth FROM r WHERE rn <= 5 GROUP BY x)
SELECT DISTINCT least(s.x, s.y) AS id_a, greatest(s.x, s.y) AS id_b FROM s JOIN k ON s.x = k.x WHERE s.s >= k.kth - 0.000001
""",
    "p6_found": f"SELECT DISTINCT doc_id, item_id FROM ({_P6})",
    "p6_report": f"SELECT item_id, count(*) AS n_docs, count(*) FILTER (q) AS n_prompt, count(*) FILTER (a) AS n_passage, count(*) FILTER (q AND a) AS n_both FROM (SELECT item_id, doc_id, bool_or(field = 'prompt') AS q, bool_or(field = 'passage') AS a FROM ({_P6}) GROUP BY 1, 2) GROUP BY 1",
}
