"""Two replicas brought together: the later update wins, row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import paths as ps
from loam.session import materialize
from loam.visibility import moment


def _sides(local: DataFrame, remote: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full join by keys, with structs l and r."""
    l = local.select(*keys, F.struct(*columns).alias("l"))  # noqa: E741
    r = remote.select(*keys, F.struct(*columns).alias("r"))
    return l.join(r, list(keys), "full")


def plan(local: DataFrame, remote: DataFrame, keys: Sequence[str], updated: str = "updated_at") -> DataFrame:
    """(keys, action): push, pull, or keep. Strictly later wins; equal times change nothing. A row without a time loses."""
    both = _sides(local, remote, keys, [updated])
    l, r = F.col(f"l.{updated}"), F.col(f"r.{updated}")  # noqa: E741
    later = lambda a, b: F.coalesce(a > b, a.isNotNull() & b.isNull())
    action = F.when(F.col("r").isNull(), "push").when(F.col("l").isNull(), "pull").when(later(l, r), "push").when(later(r, l), "pull").otherwise("keep")
    return both.select(*keys, action.alias("action"))


def merge(local: DataFrame, remote: DataFrame, keys: Sequence[str], columns: Sequence[str], updated: str = "updated_at", insert_only: Sequence[str] = ()) -> DataFrame:
    """The rows both replicas have afterwards. `insert_only` columns keep their local value where there is a local row."""
    cols = list(dict.fromkeys([*columns, updated]))
    both = _sides(local, remote, keys, cols)
    l, r = F.col(f"l.{updated}"), F.col(f"r.{updated}")  # noqa: E741
    pulled = F.col("l").isNull() | (F.col("r").isNotNull() & F.coalesce(r > l, r.isNotNull() & l.isNull()))
    pick = lambda c: F.when(F.col("l").isNull() | (pulled if c not in insert_only else F.lit(False)), F.col(f"r.{c}")).otherwise(F.col(f"l.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in cols])


def same(a: Column, b: Column, kind: str = "") -> Column:
    """Equal for the purpose of conflicts: null and an empty array are the same, floats within 1e-4."""
    if kind.startswith("array"):
        return F.coalesce(a, F.array().cast(kind)).eqNullSafe(F.coalesce(b, F.array().cast(kind)))
    if kind in ("float", "double"):
        return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= 1e-4, F.lit(False))
    return a.eqNullSafe(b)


def conflicts(local: DataFrame, remote: DataFrame, keys: Sequence[str], columns: Sequence[str], last_sync: str | None, updated: str = "updated_at") -> DataFrame:
    """(keys, winner): changed on both sides since the last sync, with different content; the local row wins a tie. Nothing before the first sync."""
    kinds = dict(local.dtypes)
    both = _sides(local, remote, keys, list(dict.fromkeys([*columns, updated]))).filter("l is not null and r is not null")
    l, r = F.col(f"l.{updated}"), F.col(f"r.{updated}")  # noqa: E741
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~same(F.col(f"l.{c}"), F.col(f"r.{c}"), kinds[c])
    since = F.lit(False) if last_sync is None else (l > moment(last_sync)) & (r > moment(last_sync))
    return both.filter(since & differs).select(*keys, F.when(l >= r, "local").otherwise("remote").alias("winner"))


def resolve_children(children: DataFrame, source_parents: DataFrame, target_parents: DataFrame, fk: str, key: str) -> DataFrame:
    """Children with the target's id of their parent, found by the key both sides share; those without are left out, those of tombstoned parents are not."""
    a = source_parents.select(F.col("id").alias(fk), F.col(key).alias("_k")).dropDuplicates([fk])
    b = target_parents.groupBy(F.col(key).alias("_k")).agg(F.min("id").alias("_new"))
    return children.join(a, fk).join(b, "_k").withColumn(fk, F.col("_new")).select(*children.columns)


def named_link_plan(local_links: DataFrame, local_nodes: DataFrame, remote_links: DataFrame, remote_nodes: DataFrame) -> DataFrame:
    """(from_path, to_path, rel_type, action) by paths, as ids differ between replicas; links of unknown ends are left out."""
    def named(links: DataFrame, nodes: DataFrame) -> DataFrame:
        a, b = nodes.select(F.col("id").alias("from_id"), F.col("path").alias("from_path")), nodes.select(F.col("id").alias("to_id"), F.col("path").alias("to_path"))
        return links.join(a, "from_id").join(b, "to_id").select("from_path", "to_path", "rel_type", "updated_at")

    return plan(named(local_links, local_nodes), named(remote_links, remote_nodes), ["from_path", "to_path", "rel_type"])


def merge_links(local_links: DataFrame, local_nodes: DataFrame, remote_links: DataFrame, remote_nodes: DataFrame) -> DataFrame:
    """The local links after a sync: those whose remote state is strictly later, or that are there only, with the local ids of their ends; left out where an end isn't there or is tombstoned. Others stay as they are."""
    def named(links: DataFrame, nodes: DataFrame) -> DataFrame:
        a, b = nodes.select(F.col("id").alias("from_id"), F.col("path").alias("from_path")), nodes.select(F.col("id").alias("to_id"), F.col("path").alias("to_path"))
        return links.join(a, "from_id").join(b, "to_id")

    keys = ["from_path", "to_path", "rel_type"]
    pulled = plan(named(local_links, local_nodes), named(remote_links, remote_nodes), keys).filter("action = 'pull'").select(*keys)
    live = local_nodes.filter("deleted_at is null")
    ends = [live.select(F.col("id").alias(f"_{x}"), F.col("path").alias(f"{x}_path")) for x in ("from", "to")]
    new = named(remote_links, remote_nodes).join(pulled, keys).join(ends[0], "from_path").join(ends[1], "to_path").drop("from_id", "to_id").withColumnsRenamed({"_from": "from_id", "_to": "to_id"}).select(*local_links.columns)
    triple = ["from_id", "to_id", "rel_type"]
    return local_links.join(new.select(*triple), triple, "left_anti").unionByName(new)


#: Tables of the journal in the order they are synced: name, key, foreign key, parent, key of the parent.
JOURNAL = (("projects", "name", None, None, None), ("milestones", "sync_id", "project_id", "projects", "name"), ("logs", "sync_id", "project_id", "projects", "name"), ("tasks", "sync_id", "milestone_id", "milestones", "sync_id"))


def sync_journal(local: dict[str, DataFrame], remote: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The local tables after a sync, parents first: by name or sync_id the strictly later row holds, with the local id of its parent.

    Rows pulled keep their local id, new ones get the next free numbers. Rows whose parent isn't there are left out; tombstoned parents
    count as there, so that the deletion of a child gets through. Created times stay as they were."""
    out: dict[str, DataFrame] = {}
    for name, key, fk, parent, parent_key in JOURNAL:
        if name not in local or name not in remote:
            continue
        mine, theirs = local[name], remote[name]
        if fk is not None:
            theirs = resolve_children(theirs, remote[parent], out.get(parent, local[parent]), fk, parent_key)
        theirs = theirs.filter(F.col(key).isNotNull())
        columns = [c for c in mine.columns if c not in (key, "id")]
        merged = merge(mine.filter(F.col(key).isNotNull()), theirs, [key], columns, insert_only=[c for c in ("created_at",) if c in columns])
        known = mine.filter(F.col(key).isNotNull()).select(key, "id")
        there = merged.join(known, key)
        new = merged.join(known, key, "left_anti")
        base = mine.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))
        # numbers without a global sort: by partition of the key's hash, each after the rows of the ones before
        new = materialize(new.withColumn("_p", F.pmod(F.xxhash64(key), F.lit(64)).cast("int")))
        sizes = new.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # at most 64 rows
        numbered = new.join(F.broadcast(before), "_p").join(F.broadcast(base)).withColumn("id", (F.col("_base") + F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(key))).cast(dict(mine.dtypes)["id"]))
        out[name] = materialize(there.select(*mine.columns).unionByName(numbered.select(*mine.columns)).unionByName(mine.filter(F.col(key).isNull())))
    return out


def incoming(nodes: DataFrame, prefix: str, types: Sequence[str] = ("user", "feedback", "project", "reference", "note"), title: int = 500, body: int = 200_000) -> DataFrame:
    """Nodes of a peer below a prefix: unsafe paths are left out, an unknown type becomes `note`, title and body are cut to so many characters."""
    rows = nodes.withColumn("path", ps.incoming_path(prefix, F.col("path"))).filter("path is not null")
    kind = F.when(F.col("type").isin(*types), F.col("type")).otherwise("note")
    return rows.withColumns({"type": kind, "title": F.substring("title", 1, title), "body": F.substring("body", 1, body)})


def backfill_parents(nodes: DataFrame) -> DataFrame:
    """(path, parent_id) as derived from the paths; null where the parent doesn't exist."""
    up = nodes.select(F.col("path").alias("_pp"), F.col("id").alias("parent_id"))
    return nodes.select("path", ps.parent_path(F.col("path")).alias("_pp")).join(up, "_pp", "left").select("path", "parent_id")


def delta(nodes: DataFrame, tags: Sequence[str], since: str | None, new_tags: Sequence[str] = ()) -> DataFrame:
    """Nodes to send to a peer: of its tags and changed since the cursor, and of newly added tags whenever they changed."""
    has = lambda ts: F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in ts]).cast("array<string>"))
    changed = F.lit(True) if since is None else F.col("updated_at") > moment(since)
    return nodes.filter(F.col("deleted_at").isNull() & ((has(tags) & changed) | has(new_tags)))
