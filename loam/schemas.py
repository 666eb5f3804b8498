"""Schemas of the stored tables, empty tables by them, settings and models kept as JSON, and a keyed table of values."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.mutate import upsert
from loam.visibility import moment

# Names and columns of the stored tables.
_SYNC = "sync_id string, updated_at timestamp_ntz, deleted_at timestamp_ntz"
SCHEMAS = {
    "memory_nodes": "id string, parent_id string, path string, slug string, type string, title string, body string, tags array<string>, importance float, access_count int, accessed_at timestamp_ntz, valid_until timestamp_ntz, origin string, provenance string, pin_triggers array<string>, trigger_keywords array<string>, config string, embedding array<float>, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz",
    "memory_links": "id string, from_id string, to_id string, rel_type string, note string, link_origin string, confidence float, evidence string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "link_suggestions": "id string, from_id string, to_id string, confidence float, evidence string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, decided_at timestamp_ntz",
    "consolidation_proposals": "kind string, paths array<string>, extra string, stamps map<string,timestamp_ntz>, fingerprint string, status string, decision string, created_at timestamp_ntz, decided_at timestamp_ntz",
    "injection_feedback": "session_id string, path string, injected_at timestamp_ntz, used boolean, score double, judged_at timestamp_ntz",
    "meta": "key string, value string, updated_at timestamp_ntz",
    "projects": "id int, name string, status string, archived boolean, config string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz",
    "milestones": f"id int, project_id int, title string, completed boolean, created_at timestamp_ntz, completed_at timestamp_ntz, {_SYNC}",
    "tasks": f"id int, milestone_id int, title string, completed boolean, created_at timestamp_ntz, {_SYNC}",
    "logs": f"id int, project_id int, logged_at timestamp_ntz, author string, entry string, level string, worker string, {_SYNC}",
    "reminders": f"id int, project_id int, target_date string, note string, completed boolean, created_at timestamp_ntz, {_SYNC}",
    "wiki_pages": f"id int, project_id int, title string, content string, created_at timestamp_ntz, {_SYNC}",
    "errors_solutions": f"id int, project_id int, error_msg string, solution_msg string, created_at timestamp_ntz, {_SYNC}",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns and types: missing ones null, others left out, values that can't be cast null."""
    want = [c.strip().split(" ", 1) for c in SCHEMAS[table].split(", ")]
    return df.select(*[(F.col(f"`{n}`").try_cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in want])


def bootstrap(spark: SparkSession, folder: str, seeds: Mapping[str, DataFrame] | None = None) -> list[str]:
    """Writes each table that the folder lacks, with its seed rows if any; those that are there stay. The names written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    made = []
    for table in SCHEMAS:
        path = f"{folder}/{table}.parquet"
        if hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(path)):
            continue
        rows = conform(seeds[table], table) if seeds and table in seeds else empty(spark, table)
        rows.write.parquet(path)
        made.append(table)
    return made


def _read_text(spark: SparkSession, path: str) -> str | None:
    try:
        return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    except Exception:
        return None


def load_settings(spark: SparkSession, path: str, defaults: Mapping) -> dict:
    """The defaults with the file's values over them; the defaults where the file is missing, can't be read or holds no object."""
    try:
        found = json.loads(_read_text(spark, path) or "")
    except ValueError:
        found = None
    return dict(defaults) | (found if isinstance(found, dict) else {})


def save_json(spark: SparkSession, path: str, value: Mapping) -> None:
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_weights(spark: SparkSession, path: str, features: Sequence[str], default: Mapping[str, float]) -> dict[str, float]:
    """A stored model: a finite number for the bias and every feature. Any defect gives the default."""
    try:
        found = json.loads(_read_text(spark, path) or "")
        weights = {k: float(found[k]) for k in ("bias", *features)}
    except (ValueError, KeyError, TypeError):
        return dict(default)
    return weights if all(abs(v) < 1e6 for v in weights.values()) else dict(default)


def put_meta(meta: DataFrame, values: Mapping[str, str], now: str) -> DataFrame:
    """The table with these keys set: cursors, summaries of runs."""
    rows = meta.sparkSession.createDataFrame(list(values.items()), "key string, value string").withColumn("updated_at", moment(now))
    return upsert(meta, rows, "key")


def run_summary(actions: DataFrame, started: str) -> DataFrame:
    """(key, value) of a linking run: when it began, and the number of its actions by kind as JSON."""
    counts = actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n"))))).alias("value"))
    return counts.select(F.lit("last_link_run").alias("key"), F.concat(F.lit(f"{started} "), F.coalesce("value", F.lit("{}"))).alias("value"))
