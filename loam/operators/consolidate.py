"""Proposals to tidy the tree: duplicates, expired and stale nodes, relative dates; queued by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.operators.neighbours import similar_pairs
from loam.visibility import content, moment


def fingerprint(kind: Column, paths: Column, extra: Column) -> Column:
    """32 hex digits over kind, sorted paths and extra."""
    return F.substring(F.sha2(F.concat_ws("|", kind, F.array_join(F.array_sort(paths), "|"), extra), 256), 1, 32)


def duplicates(nodes: DataFrame, least: float, dims: int) -> DataFrame:
    """(keep, drop, sim): similar pairs; the one of greater importance (0 if null), then accesses, then update stays, the first path on a tie."""
    key = F.struct(F.coalesce(F.col("importance").cast("double"), F.lit(0.0)).alias("i"), F.coalesce("access_count", F.lit(0)).alias("c"), "updated_at")
    keys = nodes.select("path", key.alias("k"))
    rows = similar_pairs(nodes, least, dims).join(keys.select(F.col("path").alias("path_a"), F.col("k").alias("ka")), "path_a").join(keys.select(F.col("path").alias("path_b"), F.col("k").alias("kb")), "path_b")
    first = F.col("ka") >= F.col("kb")
    return rows.select(F.when(first, F.col("path_a")).otherwise(F.col("path_b")).alias("keep"), F.when(first, F.col("path_b")).otherwise(F.col("path_a")).alias("drop"), "sim")


def expired(nodes: DataFrame, now: str, grace_days: int = 14) -> DataFrame:
    return nodes.filter(F.col("valid_until") < moment(now) - F.expr(f"INTERVAL {grace_days} DAYS")).select("path", "valid_until")


def stale(nodes: DataFrame, now: str, days: int = 180, most: float = 0.4) -> DataFrame:
    """Unimportant, unpinned nodes without expiry that weren't touched for long."""
    quiet = F.col("updated_at") < moment(now) - F.expr(f"INTERVAL {days} DAYS")
    return nodes.filter((F.round(F.col("importance").cast("double"), 6) <= most) & (F.size(F.coalesce("pin_triggers", F.array())) == 0) & F.col("valid_until").isNull() & quiet).select("path", "updated_at")


def dated(nodes: DataFrame, zone: str = "Europe/Berlin") -> DataFrame:
    """(path, dates) of nodes that speak of relative days and weren't changed after the day they were written, in a time zone."""
    local = lambda c: F.to_date(F.from_utc_timestamp(F.col(c).cast("timestamp"), zone))
    rows = nodes.filter(local("created_at") == local("updated_at")).withColumn("dates", tx.relative_dates(F.col("body"), local("created_at")))
    return rows.filter(F.size("dates") > 0).select("path", "dates")


def proposals(nodes: DataFrame, comparable: DataFrame, now: str, least: float, dims: int) -> DataFrame:
    """(kind, paths, extra, fingerprint) of all detectors. nodes: live ones, expired too; comparable: those sought for duplicates."""
    parts = [
        duplicates(comparable, least, dims).select(F.lit("duplicate").alias("kind"), F.array("keep", "drop").alias("paths"), F.lit("").alias("extra")),
        expired(nodes, now).select(F.lit("expired").alias("kind"), F.array("path").alias("paths"), F.date_format("valid_until", "yyyy-MM-dd").alias("extra")),
        stale(nodes.filter(content()), now).select(F.lit("stale").alias("kind"), F.array("path").alias("paths"), F.date_format("updated_at", "yyyy-MM-dd").alias("extra")),
        dated(nodes).select(F.lit("relative_dates").alias("kind"), F.array("path").alias("paths"), F.array_join("dates", ",").alias("extra")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("fingerprint", fingerprint(F.col("kind"), F.col("paths"), F.col("extra")))


def enqueue(found: DataFrame, queue: DataFrame) -> DataFrame:
    """The proposals that were never queued, whatever became of them."""
    return found.dropDuplicates(["fingerprint"]).join(queue.select("fingerprint"), "fingerprint", "left_anti")


def unchanged(queue: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fingerprint, ok): whether all stamped nodes (stamps: map of path to update time) are still as they were."""
    stamps = queue.select("fingerprint", F.explode("stamps").alias("path", "stamp"))
    rows = stamps.join(nodes.filter("deleted_at is null").select("path", "updated_at"), "path", "left")
    return rows.groupBy("fingerprint").agg(F.bool_and(F.coalesce(F.col("updated_at") == F.col("stamp"), F.lit(False))).alias("ok"))


def pending(queue: DataFrame, kinds: list[str]) -> DataFrame:
    """Open proposals in the order of kinds; decided ones come last by decision, undecided last of all."""
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    return queue.orderBy(order, F.desc_nulls_last("decided_at"), "fingerprint")
