"""Queries on the quality of the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.references import Reference, orphan_references, orphan_report
from loam.operators.replica_diff import diff_report, replica_diff
from loam.session import read_table

FIELDS = ("updated_at", "deleted_at", "body")
REFERENCES = (
    Reference("memory_links", ("from_id",), "memory_nodes", ("id",), fold_case=True),
    Reference("memory_links", ("to_id",), "memory_nodes", ("id",), fold_case=True),
    Reference("tasks", ("milestone_id",), "milestones", ("id",)),
    Reference("milestones", ("project_id",), "projects", ("id",)),
)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return replica_diff(read_table(spark, d, "memory_nodes"), read_table(spark, d, "memory_nodes_remote"), "path", FIELDS, order="updated_at")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return diff_report(p3_found(spark, d))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    names = {t for r in REFERENCES for t in (r.table, r.target)}
    return orphan_references(REFERENCES, {t: read_table(spark, d, t) for t in names})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("created_at")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d)).withColumn("period", F.col("period").cast("string"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_report": p4_report}

_P3 = """
WITH l AS (SELECT path, updated_at, deleted_at, body FROM memory_nodes),
r AS (SELECT path, updated_at, deleted_at, body FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC) AS rn FROM memory_nodes_remote) WHERE rn = 1)
SELECT l.path, 'only_local' AS diff FROM l LEFT JOIN r ON l.path = r.path WHERE r.path IS NULL
UNION ALL SELECT r.path, 'only_remote' FROM r LEFT JOIN l ON l.path = r.path WHERE l.path IS NULL
UNION ALL SELECT l.path, 'updated_at' FROM l JOIN r ON l.path = r.path WHERE l.updated_at IS DISTINCT FROM r.updated_at
UNION ALL SELECT l.path, 'deleted_at' FROM l JOIN r ON l.path = r.path WHERE l.deleted_at IS DISTINCT FROM r.deleted_at
UNION ALL SELECT l.path, 'body' FROM l JOIN r ON l.path = r.path WHERE l.body IS DISTINCT FROM r.body
"""


def _p4_one(ref: Reference) -> str:
    fold = (lambda x: f"lower({x})") if ref.fold_case else (lambda x: x)
    return f"""
SELECT '{ref.table}' AS ref_table, '{ref.name}' AS ref_field, CAST(s.id AS VARCHAR) AS ref_id, s.created_at,
  CASE WHEN t.k IS NULL THEN 'missing' WHEN t.deleted_at IS NOT NULL THEN 'deleted' ELSE 'late' END AS kind
FROM (SELECT id, {fold(ref.fields[0])} AS k, min(created_at) AS created_at FROM {ref.table} WHERE {ref.fields[0]} IS NOT NULL GROUP BY 1, 2) s
LEFT JOIN (SELECT DISTINCT {fold(ref.target_keys[0])} AS k, deleted_at, created_at FROM {ref.target}) t ON s.k = t.k
WHERE t.k IS NULL OR t.deleted_at IS NOT NULL OR t.created_at > s.created_at"""


_P4 = "\nUNION ALL".join(map(_p4_one, REFERENCES))

ORACLE = {
    "p3_found": _P3,
    "p3_report": f"SELECT diff, count(*) AS n FROM ({_P3}) GROUP BY diff",
    "p4_found": f"SELECT ref_table, ref_field, ref_id, kind FROM ({_P4})",
    "p4_report": f"SELECT ref_table, ref_field, kind, CAST(CAST(date_trunc('month', created_at) AS DATE) AS VARCHAR) AS period, count(*) AS n FROM ({_P4}) GROUP BY 1, 2, 3, 4",
}
