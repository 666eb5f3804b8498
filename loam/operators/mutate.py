"""Changes as new snapshots: every function takes tables and returns the tables as they are afterwards. Write them to another
path than the one read, and swap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import paths as ps
from loam.session import lookup_join, materialize
from loam.visibility import moment

# Link types without a direction.
SYMMETRIC = ("related", "supports", "contradicts")


def upsert(current: DataFrame, changes: DataFrame, key: str, keep_if_null: Sequence[str] = (), keep_old: Sequence[str] = ()) -> DataFrame:
    """Insert, update and revive by key: columns of changes replace those of current, `keep_if_null` unless null, `keep_old` only on insert. A changed row loses its tombstone if both have `deleted_at` (null in changes)."""
    new = changes.select(*[F.col(c).alias(f"_n_{c}") for c in changes.columns], F.lit(True).alias("_new"))
    both = current.withColumn("_old", F.lit(True)).join(new, current[key] == new[f"_n_{key}"], "full")

    def value(c: str) -> Column:
        if c not in changes.columns:
            return F.col(c)
        n = F.col(f"_n_{c}")
        if c in keep_old:
            n = F.when(F.col("_old"), F.col(c)).otherwise(n)
        elif c in keep_if_null:
            n = F.coalesce(n, F.col(c))
        return F.when(F.col("_new"), n).otherwise(F.col(c))

    return both.select(*[value(c).alias(c) for c in current.columns])


def missing_ancestors(nodes: DataFrame) -> DataFrame:
    """(path) of ancestors that don't exist."""
    up = nodes.select(F.explode(ps.ancestors(F.col("path"))).alias("path")).distinct()
    return up.join(nodes.select("path"), "path", "left_anti")


def ensure_ancestors(nodes: DataFrame, now: str, kind: str = "category") -> DataFrame:
    """nodes with every ancestor of a live node there and live: missing ones are added as nodes of a kind, tombstoned ones are revived."""
    needed = nodes.filter("deleted_at is null").select(F.explode(ps.ancestors(F.col("path"))).alias("path")).distinct()
    rows = nodes.join(needed.withColumn("_need", F.lit(True)), "path", "left")
    back = F.col("_need") & F.col("deleted_at").isNotNull()
    kept = rows.withColumn("updated_at", F.when(back, moment(now)).otherwise(F.col("updated_at"))).withColumn("deleted_at", F.when(~F.coalesce(back, F.lit(False)), F.col("deleted_at"))).select(*nodes.columns)
    name = F.element_at(F.split("path", "/"), -1)
    added = needed.join(nodes.select("path"), "path", "left_anti").select(F.substring(F.sha2("path", 256), 1, 32).alias("id"), "path", name.alias("slug"), name.alias("title"), F.lit(kind).alias("type"), F.lit("curated").alias("origin"), F.lit(0.5).cast("float").alias("importance"), F.lit(0).alias("access_count"), moment(now).alias("created_at"), moment(now).alias("updated_at"))
    return kept.unionByName(added.select(*[c for c in added.columns if c in nodes.columns]), allowMissingColumns=True)


def save_nodes(nodes: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Nodes upserted by path with all their ancestors; changed rows are live and updated now, provenance and creation stay where they were."""
    new = changes.withColumns({"updated_at": moment(now), "created_at": F.coalesce("created_at", moment(now)) if "created_at" in changes.columns else moment(now), "deleted_at": F.lit(None).cast("timestamp_ntz")})
    if "id" not in new.columns:
        new = new.withColumn("id", F.substring(F.sha2("path", 256), 1, 32))
    return ensure_ancestors(upsert(nodes, new, "path", keep_if_null=["provenance"], keep_old=["created_at", "id"]), now)


def save_extracted(nodes: DataFrame, texts: DataFrame, now: str, days: int = 90, importance: float = 0.3) -> DataFrame:
    """Texts (path, title, body) of transcripts as nodes of the extracted tier that expire after `days`; a curated node of that path stays as it is."""
    mine = texts.join(nodes.filter("origin = 'curated' and deleted_at is null").select("path"), "path", "left_anti")
    rows = mine.select("path", "title", "body", F.element_at(F.split("path", "/"), -1).alias("slug"), F.lit("note").alias("type"), F.lit("extracted").alias("origin"), F.lit(importance).cast("float").alias("importance"), (moment(now) + F.expr(f"INTERVAL {days} DAYS")).alias("valid_until"))
    return save_nodes(nodes, rows, now)


def pin(nodes: DataFrame, paths: DataFrame, triggers: Sequence[str], now: str) -> DataFrame:
    """Nodes (path) pinned to triggers, or unpinned by none. Only nodes below a project can be pinned."""
    wanted = paths.select("path").distinct().withColumn("_p", F.lit(True))
    rows = nodes.join(wanted, "path", "left")
    hit = F.coalesce(F.col("_p"), F.lit(False)) & F.col("deleted_at").isNull() & (ps.pinnable(F.col("path")) | F.lit(not triggers))
    return rows.withColumns({"pin_triggers": F.when(hit, F.array(*[F.lit(t) for t in triggers]).cast("array<string>")).otherwise(F.col("pin_triggers")), "updated_at": F.when(hit, moment(now)).otherwise(F.col("updated_at"))}).select(*nodes.columns)


def set_folder(nodes: DataFrame, slug: str, folder: str, present: bool = True) -> DataFrame:
    """A working folder added to a project's config, or taken from it; other settings stay."""
    dirs = F.coalesce(F.from_json(F.get_json_object("config", "$.dirs"), "array<string>"), F.array().cast("array<string>"))
    dirs = F.array_union(dirs, F.array(F.lit(folder))) if present else F.array_remove(dirs, folder)
    old = F.map_filter(F.coalesce(F.from_json("config", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: k != "dirs")
    # values that are objects, lists, numbers or booleans come back from the map as their JSON text, and go out as that
    value = lambda v: F.when(v.isNull(), "null").when(v.rlike(r"^(?:[\[{].*|-?\d+(?:\.\d+)?|true|false)$"), v).otherwise(F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))
    pairs = F.transform(F.map_entries(old), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), value(e["value"])))
    text = F.concat(F.lit("{"), F.array_join(F.array_append(pairs, F.concat(F.lit('"dirs":'), F.to_json(dirs))), ","), F.lit("}"))
    return nodes.withColumn("config", F.when(F.col("path") == f"/projects/{slug}", text).otherwise(F.col("config")))


def seed_missing(seeds: DataFrame, nodes: DataFrame, key: str = "path") -> DataFrame:
    """nodes and those seeds that it lacks."""
    return nodes.unionByName(seeds.join(nodes.select(key), key, "left_anti"), allowMissingColumns=True)


def tombstone_subtree(nodes: DataFrame, root: str, now: str) -> DataFrame:
    hit = ps.in_subtree(F.col("path"), root) & F.col("deleted_at").isNull()
    return nodes.withColumn("deleted_at", F.when(hit, moment(now)).otherwise(F.col("deleted_at"))).withColumn("updated_at", F.when(hit, moment(now)).otherwise(F.col("updated_at")))


def promote(nodes: DataFrame, path: str, importance: float = 0.7) -> DataFrame:
    """An extracted node becomes curated: no expiry, more importance."""
    hit = (F.col("path") == path) & (F.col("origin") == "extracted")
    return nodes.withColumns({"importance": F.when(hit, F.lit(importance).cast("float")).otherwise(F.col("importance")), "valid_until": F.when(~hit, F.col("valid_until")), "origin": F.when(hit, "curated").otherwise(F.col("origin"))})


def prune_extracted(nodes: DataFrame, now: str, keep: int = 0, expired_only: bool = True) -> DataFrame:
    """Tombstone extracted nodes: all but the newest `keep` of a project (if keep > 0), then the expired ones, or all that is left.

    With expired_only=False nothing extracted stays, whatever `keep` is."""
    target = F.col("deleted_at").isNull() & (F.col("origin") == "extracted")
    w = Window.partitionBy(F.when(target, ps.project_slug(F.col("path")))).orderBy(F.desc(F.when(target, F.col("created_at"))), "path")
    rows = nodes.withColumn("_r", F.row_number().over(w)) if keep > 0 else nodes.withColumn("_r", F.lit(0))
    late = F.col("valid_until") < moment(now) if expired_only else F.lit(True)
    surplus = (F.col("_r") > keep) & ps.project_slug(F.col("path")).isNotNull() if keep > 0 else F.lit(False)
    return rows.withColumn("deleted_at", F.when(target & (surplus | F.coalesce(late, F.lit(False))), moment(now)).otherwise(F.col("deleted_at"))).drop("_r")


def purge(nodes: DataFrame, links: DataFrame, now: str, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Without tombstones older than `days`, and without the links that touch them."""
    old = F.coalesce(F.col("deleted_at") < moment(now) - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    gone = nodes.filter(old).select("id")
    kept = links.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return nodes.filter(~old), kept


def repoint(links: DataFrame, old: str, new: str) -> DataFrame:
    """Links of one node moved to another: no loops, and of links that become equal the one that was there stays."""
    to = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c))
    moved = links.withColumn("_m", ((F.col("from_id") == old) | (F.col("to_id") == old)).cast("int")).withColumn("from_id", to("from_id")).withColumn("to_id", to("to_id"))
    w = Window.partitionBy("from_id", "to_id", "rel_type").orderBy("_m", "id")
    return moved.filter((F.col("_m") == 0) | (F.col("from_id") != F.col("to_id"))).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_m")


def merge_nodes(nodes: DataFrame, links: DataFrame, keep: str, drop: str, now: str) -> tuple[DataFrame, DataFrame]:
    """One node's body appended to another's, its links moved, itself tombstoned. keep and drop are ids."""
    source = F.broadcast(nodes.filter(F.col("id") == drop).select(F.col("path").alias("_p"), F.col("body").alias("_b")))
    joined = nodes.join(source, F.col("id") == keep, "left")
    body = F.when((F.col("id") == keep) & F.col("_p").isNotNull(), F.trim(F.concat_ws("\n\n", "body", F.concat(F.lit("--- from "), "_p"), "_b"))).otherwise(F.col("body"))
    out = joined.withColumn("body", body).drop("_p", "_b").withColumn("deleted_at", F.when(F.col("id") == drop, moment(now)).otherwise(F.col("deleted_at")))
    return out, repoint(links, drop, keep)


def merge_pairs(nodes: DataFrame, links: DataFrame, pairs: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """As merge_nodes, for many pairs (keep, drop) of paths at once; each node is in one pair at most."""
    live = nodes.filter("deleted_at is null").select("path", "id", "body")
    found = pairs.join(live.select(F.col("path").alias("keep"), F.col("id").alias("to")), "keep").join(live.select(F.col("path").alias("drop"), F.col("id").alias("from"), F.col("body").alias("_b")), "drop")
    found = materialize(found)
    rows = nodes.join(found.select(F.col("keep").alias("path"), F.col("drop").alias("_p"), "_b"), "path", "left").join(found.select(F.col("drop").alias("path"), F.lit(True).alias("_gone")), "path", "left")
    body = F.when(F.col("_p").isNotNull(), F.trim(F.concat_ws("\n\n", "body", F.concat(F.lit("--- from "), "_p"), "_b"))).otherwise(F.col("body"))
    touched = F.col("_p").isNotNull() | F.coalesce(F.col("_gone"), F.lit(False))
    out = rows.withColumns({"body": body, "deleted_at": F.when(F.col("_gone"), moment(now)).otherwise(F.col("deleted_at")), "updated_at": F.when(touched, moment(now)).otherwise(F.col("updated_at"))}).select(*nodes.columns)
    to = found.select(F.col("from").alias("_f"), F.col("to").alias("_t"))
    moved = links.join(to.withColumnsRenamed({"_f": "from_id", "_t": "_a"}), "from_id", "left").join(to.withColumnsRenamed({"_f": "to_id", "_t": "_b"}), "to_id", "left")
    moved = moved.withColumn("_m", (F.col("_a").isNotNull() | F.col("_b").isNotNull()).cast("int")).withColumns({"from_id": F.coalesce("_a", "from_id"), "to_id": F.coalesce("_b", "to_id")})
    w = Window.partitionBy("from_id", "to_id", "rel_type").orderBy("_m", "id")
    kept = moved.filter("_m = 0 or from_id != to_id").withColumn("_r", F.row_number().over(w)).filter("_m = 0 or _r = 1")
    return out, kept.select(*links.columns)


def count_access(nodes: DataFrame, reads: DataFrame) -> DataFrame:
    """access_count and accessed_at after the reads (path, at)."""
    n = reads.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    rows = nodes.join(n, "path", "left")
    return rows.withColumn("access_count", (F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int")).withColumn("accessed_at", F.coalesce(F.greatest("accessed_at", "_at"), F.col("accessed_at"))).drop("_n", "_at").select(*nodes.columns)


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Explicit links added; one that is there, for symmetric types in either direction, is made explicit instead of doubled."""
    def key(df: DataFrame) -> DataFrame:
        sym = F.col("rel_type").isin(*SYMMETRIC)
        return df.withColumn("_a", F.when(sym, F.least("from_id", "to_id")).otherwise(F.col("from_id"))).withColumn("_b", F.when(sym, F.greatest("from_id", "to_id")).otherwise(F.col("to_id")))

    wanted = key(new).dropDuplicates(["_a", "_b", "rel_type"])
    there = key(links).join(wanted.select("_a", "_b", "rel_type", F.lit(True).alias("_w")), ["_a", "_b", "rel_type"], "left")
    kept = there.withColumn("link_origin", F.when(F.col("_w"), "explicit").otherwise(F.col("link_origin"))).select(*links.columns)
    added = wanted.join(key(links).select("_a", "_b", "rel_type"), ["_a", "_b", "rel_type"], "left_anti").withColumn("link_origin", F.lit("explicit"))
    return kept.unionByName(added.drop("_a", "_b"), allowMissingColumns=True)


def retention(logs: DataFrame, projects: DataFrame, now: str) -> DataFrame:
    """Logs within their project's days, as its config says (the most, if the project comes several times); all of a project that says nothing."""
    days = projects.groupBy(F.col("id").alias("project_id")).agg(F.max(F.expr("try_cast(get_json_object(config, '$.log_retention_days') as int)")).alias("_d"))
    rows = lookup_join(logs, materialize(days), "project_id", "left")
    return rows.filter(F.col("_d").isNull() | F.col("logged_at").isNull() | (F.col("logged_at") >= F.expr(f"timestamp_ntz'{now}' - make_interval(0, 0, 0, coalesce(_d, 0))"))).drop("_d").select(*logs.columns)


def cascade(children: DataFrame, parents: DataFrame, key: str, now: str) -> DataFrame:
    """Children of tombstoned parents tombstoned too."""
    gone = parents.filter("deleted_at is not null").select(F.col("id").alias(key), F.lit(True).alias("_gone")).distinct()
    rows = children.join(gone, key, "left")
    return rows.withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), moment(now)).otherwise(F.col("deleted_at"))).select(*children.columns)


def delete_projects(projects: DataFrame, milestones: DataFrame, tasks: DataFrame, names: Sequence[str], now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projects tombstoned by name, with their milestones and those milestones' tasks."""
    hit = F.col("name").isin(*names) & F.col("deleted_at").isNull()
    p = projects.withColumns({"updated_at": F.when(hit, moment(now)).otherwise(F.col("updated_at")), "deleted_at": F.when(hit, moment(now)).otherwise(F.col("deleted_at"))})
    m = cascade(milestones, p, "project_id", now)
    return p, m, cascade(tasks, m, "milestone_id", now)


def edit_config(projects: DataFrame, name: str, values: dict[str, str]) -> DataFrame:
    """JSON settings of one project, replaced key by key; an unreadable config counts as empty."""
    new = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    old = F.coalesce(F.from_json("config", "map<string,string>"), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(*values)), new)
    return projects.withColumn("config", F.when(F.col("name") == name, F.to_json(merged)).otherwise(F.col("config")))


def set_values(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """A conditional update: importance, pins, completion, titles, decisions."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def snooze(date: Column, days: int) -> Column:
    """A date text moved on, in its own format (date, or date and time); as it is where it can't be read."""
    short, full = F.try_to_timestamp(date, F.lit("yyyy-MM-dd")), F.try_to_timestamp(date, F.lit("yyyy-MM-dd HH:mm"))
    return F.coalesce(F.when(F.length(date) == 10, F.date_format(F.date_add(short.cast("date"), days), "yyyy-MM-dd")), F.date_format(full + F.expr(f"INTERVAL {days} DAYS"), "yyyy-MM-dd HH:mm"), date)
