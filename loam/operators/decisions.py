"""Decisions: on suggested links, and on proposals to tidy the tree. Every function takes tables and returns them as they are afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.operators import mutate
from loam.operators.consolidate import unchanged
from loam.session import materialize
from loam.visibility import moment

# The link types a reviewer may choose, and what may be decided on each kind of proposal.
REL_TYPES = ("related", "supports", "contradicts", "requires", "derived_from")
ALLOWED = {"duplicate": ("merge", "supersede", "reject"), "expired": ("delete", "reject"), "stale": ("archive", "reject"), "relative_dates": ("rewrite", "reject")}


def suggest(suggestions: DataFrame, scored: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Suggestions after a run: pending ones get the new confidence where it moved, pairs never suggested are added as pending. scored: (a, b, confidence, evidence) of paths; ids: (path, id)."""
    a, b = ids.select(F.col("path").alias("a"), F.col("id").alias("x")), ids.select(F.col("path").alias("b"), F.col("id").alias("y"))
    new = scored.join(a, "a").join(b, "b").select(F.least("x", "y").alias("from_id"), F.greatest("x", "y").alias("to_id"), F.col("confidence").cast("float").alias("_c"), F.col("evidence").alias("_e"))
    there = suggestions.join(new, ["from_id", "to_id"], "left")
    moved = (F.col("status") == "pending") & F.col("_c").isNotNull() & ((F.abs(F.col("confidence") - F.col("_c")) > 1e-4) | ~F.col("evidence").eqNullSafe(F.col("_e")))
    there = there.withColumns({"confidence": F.when(moved, F.col("_c")).otherwise(F.col("confidence")), "evidence": F.when(moved, F.col("_e")).otherwise(F.col("evidence")), "updated_at": F.when(moved, moment(now)).otherwise(F.col("updated_at"))}).select(*suggestions.columns)
    added = new.join(suggestions.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti").select(F.expr("substring(sha2(concat_ws('|', from_id, to_id), 256), 1, 32)").alias("id"), "from_id", "to_id", F.col("_c").alias("confidence"), F.col("_e").alias("evidence"), F.lit("pending").alias("status"), moment(now).alias("created_at"), moment(now).alias("updated_at"))
    return there.unionByName(added, allowMissingColumns=True)


def pending_links(suggestions: DataFrame, nodes: DataFrame, least: float = 0.0, limit: int | None = None) -> DataFrame:
    """(id, confidence, evidence, a_path, a_title, a_hook, b_path, b_title, b_hook, total): open suggestions between live nodes, the most confident first; total counts all open ones, whatever the limit and the least confidence."""
    n = nodes.filter("deleted_at is null").select("id", "path", "title", tx.first_sentence(F.col("body")).alias("hook"))
    side = lambda s, key: n.select(F.col("id").alias(key), *[F.col(c).alias(f"{s}_{c}") for c in ("path", "title", "hook")])
    rows = suggestions.filter("status = 'pending'").join(side("a", "from_id"), "from_id").join(side("b", "to_id"), "to_id")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    out = rows.filter(F.round(F.col("confidence").cast("double"), 6) >= least).join(F.broadcast(total)).orderBy(F.desc("confidence"), "created_at", "id")
    out = out if limit is None else out.limit(limit)
    return out.select("id", "confidence", "evidence", *[f"{s}_{c}" for s in "ab" for c in ("path", "title", "hook")], "total")


def decide_links(suggestions: DataFrame, links: DataFrame, decided: DataFrame, now: str, rel_type: str = "related", note: str = "") -> tuple[DataFrame, DataFrame]:
    """Suggestions and links after decisions (id, decision: approve or reject). Only pending suggestions change; an approved one becomes a deliberate link."""
    if rel_type not in REL_TYPES:
        raise ValueError(f"rel_type must be one of {REL_TYPES}")
    told = decided.groupBy("id").agg(F.min("decision").alias("_d")).select("id", F.when(F.col("_d").isin("approve", "reject"), F.col("_d")).otherwise(F.raise_error(F.lit("a decision must be approve or reject"))).alias("_d"))
    rows = materialize(suggestions.join(told, "id", "left").withColumn("_d", F.when(F.col("status") == "pending", F.col("_d"))))
    status = F.when(F.col("_d") == "approve", "approved").when(F.col("_d") == "reject", "rejected").otherwise(F.col("status"))
    changed = lambda c: F.when(F.col("_d").isNotNull(), moment(now)).otherwise(F.col(c))
    after = rows.withColumns({"status": status, "decided_at": changed("decided_at"), "updated_at": changed("updated_at")}).select(*suggestions.columns)
    text = F.lit(note) if note else F.format_string("confirmed suggestion (confidence %.2f)", F.col("confidence"))
    new = rows.filter("_d = 'approve'").select(F.concat(F.lit("s-"), "id").alias("id"), "from_id", "to_id", F.lit(rel_type).alias("rel_type"), text.alias("note"), "confidence", "evidence", moment(now).alias("created_at"), moment(now).alias("updated_at"))
    return after, mutate.add_links(links, new)


def supersede(nodes: DataFrame, links: DataFrame, pairs: DataFrame, now: str, note: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes (new, old: paths, different, both live) of which the new one replaces the old: a `supersedes` link, and the old one expires now. It stays readable."""
    live = nodes.filter("deleted_at is null").select("path", "id")
    found = pairs.filter("new != old").join(live.select(F.col("path").alias("new"), F.col("id").alias("from_id")), "new").join(live.select(F.col("path").alias("old"), F.col("id").alias("to_id")), "old")
    found = materialize(found.distinct())
    rows = nodes.join(found.select(F.col("old").alias("path"), F.lit(True).alias("_o")).distinct(), "path", "left")
    expire = lambda c: F.when(F.col("_o") & F.col("deleted_at").isNull(), moment(now)).otherwise(F.col(c))
    after = rows.withColumns({"valid_until": expire("valid_until"), "updated_at": expire("updated_at")}).select(*nodes.columns)
    new = found.select(F.expr("concat('x-', substring(sha2(concat_ws('|', from_id, to_id), 256), 1, 30))").alias("id"), "from_id", "to_id", F.lit("supersedes").alias("rel_type"), F.lit(note).alias("note"), moment(now).alias("created_at"), moment(now).alias("updated_at"))
    return after, mutate.add_links(links, new)


def stamped(proposals: DataFrame, nodes: DataFrame, now: str) -> DataFrame:
    """Proposals (kind, paths, extra, fingerprint) ready to be queued: pending, with the update times of their nodes."""
    each = proposals.select("fingerprint", F.explode("paths").alias("path")).join(nodes.select("path", "updated_at"), "path")
    stamps = each.groupBy("fingerprint").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("path", "updated_at")))).alias("stamps"))
    return proposals.join(stamps, "fingerprint").withColumns({"status": F.lit("pending"), "decision": F.lit(None).cast("string"), "created_at": moment(now), "decided_at": F.lit(None).cast("timestamp_ntz")})


def decide(proposals: DataFrame, nodes: DataFrame, links: DataFrame, decided: DataFrame, now: str, zone: str = "Europe/Berlin") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Proposals, nodes and links after decisions (fingerprint, decision).

    Only pending proposals are decided. `reject` closes one; one whose nodes changed since it was made becomes `outdated`; the others are
    applied: duplicates are merged or superseded, expired nodes deleted, stale ones archived, relative days replaced by their date. Of
    several accepted proposals on one node, the first by fingerprint is applied and the others stay pending, as they would have
    to be looked at again. A decision that the kind doesn't allow is an error."""
    told = decided.groupBy("fingerprint").agg(F.min("decision").alias("_d"))
    rows = proposals.join(told, "fingerprint", "left").withColumn("_d", F.when(F.col("status") == "pending", F.col("_d")))
    allowed = F.create_map(*[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*[F.lit(d) for d in v]))])
    wrong = F.col("_d").isNotNull() & ~F.coalesce(F.array_contains(allowed[F.col("kind")], F.col("_d")), F.lit(False))
    rows = rows.withColumn("_d", F.when(wrong, F.raise_error(F.concat_ws(" ", F.lit("not allowed:"), "kind", "_d")).cast("string")).otherwise(F.col("_d")))
    rows = materialize(rows.join(unchanged(rows.filter("_d is not null and _d != 'reject'"), nodes).withColumnRenamed("ok", "_ok"), "fingerprint", "left"))
    ready = rows.filter("_d is not null and _d != 'reject' and _ok")
    each = ready.select("fingerprint", F.explode("paths").alias("path"))
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy("fingerprint"))).groupBy("fingerprint").agg(F.max("_r").alias("_r")).filter("_r = 1").select("fingerprint", F.lit(True).alias("_do"))
    rows = materialize(rows.join(first, "fingerprint", "left"))
    status = F.when(F.col("_d") == "reject", "rejected").when(F.col("_d").isNotNull() & ~F.coalesce("_ok", F.lit(False)), "outdated").when(F.col("_do"), "applied").otherwise(F.col("status"))
    rows = rows.withColumn("_s", status)
    closed = F.col("_s") != F.col("status")
    after = rows.withColumns({"decision": F.when(closed, F.col("_d")).otherwise(F.col("decision")), "decided_at": F.when(closed, moment(now)).otherwise(F.col("decided_at")), "status": F.col("_s")}).select(*proposals.columns)

    act = rows.filter("_do")
    single = act.filter("kind != 'duplicate'").select(F.col("paths")[0].alias("path"), F.col("kind").alias("_k"))
    n = nodes.join(single, "path", "left")
    hit = F.col("_k").isNotNull() & F.col("deleted_at").isNull()
    day = F.to_date(F.from_utc_timestamp(F.col("created_at").cast("timestamp"), zone))
    n = n.withColumns({
        "body": F.when(F.col("_k") == "relative_dates", tx.replace_relative_dates(F.col("body"), day)).otherwise(F.col("body")),
        "deleted_at": F.when(hit & (F.col("_k") == "expired"), moment(now)).otherwise(F.col("deleted_at")),
        "valid_until": F.when(hit & (F.col("_k") == "stale"), moment(now)).otherwise(F.col("valid_until")),
        "updated_at": F.when(hit, moment(now)).otherwise(F.col("updated_at")),
    }).select(*nodes.columns)
    pairs = act.filter("kind = 'duplicate'").select(F.col("paths")[0].alias("new"), F.col("paths")[1].alias("old"), "_d")
    n, l = supersede(materialize(n), links, pairs.filter("_d = 'supersede'"), now)  # noqa: E741
    n, l = mutate.merge_pairs(materialize(n), materialize(l), pairs.filter("_d = 'merge'").select(F.col("new").alias("keep"), F.col("old").alias("drop")), now)  # noqa: E741
    return after, n, l


def history(proposals: DataFrame, limit: int = 50) -> DataFrame:
    """Decided proposals, the newest first."""
    return proposals.filter("status != 'pending'").orderBy(F.desc_nulls_last("decided_at"), "fingerprint").limit(limit)
