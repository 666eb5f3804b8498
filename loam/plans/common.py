"""What the queries share: the clock, the tables as reads see them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.text import STOP_WORDS
from loam.session import read_table
from loam.visibility import visible

NOW = "2026-11-06 00:00:00"
DIMS = 384
QUERY_TYPE = "feedback"

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries with the SQL that gives the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "memory_nodes")


def links(spark: SparkSession, d: str) -> DataFrame:
    from loam.operators.graph import links_of

    return links_of(read_table(spark, d, "memory_links"))


def shown(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that a search may return."""
    return nodes(spark, d).filter(visible(NOW, categories=False, auto=False))


def node_queries(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of one type as queries: title and vector."""
    return nodes(spark, d).filter((F.col("type") == QUERY_TYPE) & F.col("deleted_at").isNull()).select(F.col("path").alias("query"), F.col("title").alias("text"), F.col("embedding").alias("vector"))


T = f"TIMESTAMP '{NOW}'"
LIVE = "deleted_at IS NULL"
FRESH = f"(valid_until IS NULL OR valid_until >= {T})"
VISIBLE = f"{LIVE} AND origin = 'curated' AND {FRESH}"
SHOWN = f"(SELECT * FROM memory_nodes WHERE {VISIBLE} AND type <> 'category' AND NOT contains(path, '/auto/'))"
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
LINKS = "(SELECT id, lower(any_value(from_id)) AS from_id, lower(any_value(to_id)) AS to_id, any_value(rel_type) AS rel_type, any_value(link_origin) AS link_origin, any_value(confidence) AS confidence, any_value(created_at) AS created_at, any_value(updated_at) AS updated_at FROM memory_links GROUP BY id)"
IMPORTANCE = "(CASE WHEN importance IS NULL OR importance = 0 THEN 0.5 ELSE CAST(importance AS DOUBLE) END)"
QUERIES = f"(SELECT path AS query, title AS text, CAST(embedding AS DOUBLE[]) AS vector FROM memory_nodes WHERE type = '{QUERY_TYPE}' AND {LIVE})"
SLUG = "(CASE WHEN starts_with(path, '/projects/') AND split_part(path, '/', 3) <> '' THEN split_part(path, '/', 3) END)"
BRANCH = "(CASE WHEN regexp_matches(path, '^/projects/[^/]+') THEN '/projects/' || split_part(path, '/', 3) ELSE '/' || split_part(path, '/', 2) END)"
DOC = "(coalesce(title, '') || ' ' || coalesce(body, ''))"


def terms(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 2 AND NOT list_contains({STOP}, x))"


def usable(v: str) -> str:
    return f"(len({v}) = {DIMS} AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0)"


def array_text(column: str) -> str:
    return f"array_to_string({column}, ',')"
