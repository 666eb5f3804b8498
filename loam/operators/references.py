"""References to records that do not exist: anti-joins by null mask with declared match semantics."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.session import lookup_join, materialize, null_safe_hash

MATCHES = ("simple", "partial", "full")


@dataclass(frozen=True)
class Reference:
    """fields of `table` refer to target_keys of `target`, in this order.

    match: what nulls mean in a composite key. simple: a reference with any null is none. full: one that is null
    throughout is none, one that is null in part is a case of its own (`partial_null`). partial: its other columns have
    to be those of some target row. fold_case: keys compare without regard to case."""

    table: str
    fields: tuple[str, ...]
    target: str
    target_keys: tuple[str, ...]
    match: str = "simple"
    fold_case: bool = False

    @property
    def name(self) -> str:
        return ",".join(self.fields)


def _key(column: str, fold: bool) -> Column:
    text = F.col(f"`{column}`").cast("string")
    return F.lower(text) if fold else text


def latest_rows(df: DataFrame, keys: Sequence[str], values: dict[str, Column], order: Column) -> DataFrame:
    """One row a key: the one with the latest order (null is the earliest; among equal ones the greatest values). Summed up in each task before the shuffle."""
    state = F.struct(order.alias("_order"), *[v.alias(k) for k, v in values.items()])
    return df.groupBy(*keys).agg(F.max(state).alias("_s")).select(*keys, *[f"_s.{k}" for k in values])


def orphans(ref: Reference, rows: DataFrame, target: DataFrame, id_column: str = "id", created: str = "created_at", updated: str = "updated_at", deleted: str = "deleted_at") -> DataFrame:
    """Rows (ref_table, ref_field, ref_id, kind, created_at) for the references of `rows` that have no proper target.

    kind: `missing` (no such target row), else `deleted` (every one has `deleted` set), else `late` (every one that is
    left was created after the referring row), or `partial_null` under full match. Rows of one id count once, with their
    latest state by `updated`; so do target rows of one key. Rows without an id count each by its values. A null `created`
    on either side is never late. Tombstoned referring rows count too. Extra columns are ignored.

    The keys referred to are made distinct before the join with the target, so a hot key crosses it once; the rows of
    the bad keys are then looked up by a broadcast of checked size, or salted."""
    if ref.match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    width = len(ref.fields)
    k, t = [f"_k{i}" for i in range(width)], [f"_t{i}" for i in range(width)]
    refs = latest_rows(
        rows.select(F.col(f"`{id_column}`").cast("string").alias("ref_id"), F.when(F.col(f"`{id_column}`").isNull(), null_safe_hash([*ref.fields, created])).alias("_row"), F.col(f"`{updated}`").alias("_u"), F.col(f"`{created}`").alias("_c"), *[_key(c, ref.fold_case).alias(a) for c, a in zip(ref.fields, k, strict=True)]),
        ["ref_id", "_row"],
        {a: F.col(a) for a in ["_c", *k]},
        F.col("_u"),
    )
    states = latest_rows(
        target.select(*[_key(c, ref.fold_case).alias(a) for c, a in zip(ref.target_keys, t, strict=True)], F.col(f"`{updated}`").alias("_u"), F.col(f"`{created}`").alias("_tc"), F.col(f"`{deleted}`").isNotNull().alias("_td")),
        t,
        {"_tc": F.col("_tc"), "_td": F.col("_td")},
        F.col("_u"),
    )

    def named(df: DataFrame, kind: Column) -> DataFrame:
        return df.select(F.lit(ref.table).alias("ref_table"), F.lit(ref.name).alias("ref_field"), "ref_id", kind.alias("kind"), F.col("_c").alias("created_at"))

    out = []
    for mask in itertools.product((True, False), repeat=width):  # True: the column has a value
        if not any(mask) or (ref.match == "simple" and not all(mask)):
            continue
        masked = refs.filter(reduce(Column.__and__, [F.col(a).isNotNull() if there else F.col(a).isNull() for a, there in zip(k, mask, strict=True)]))
        if ref.match == "full" and not all(mask):
            out.append(named(masked, F.lit("partial_null")))
            continue
        by_r = [a for a, there in zip(k, mask, strict=True) if there]
        by_t = [a for a, there in zip(t, mask, strict=True) if there]
        wanted = masked.groupBy(*by_r).agg(F.min("_c").alias("_first"))
        there = states.dropna(subset=by_t).groupBy(*by_t).agg(F.bool_and("_td").alias("_td"), F.when(~F.bool_or(~F.col("_td") & F.col("_tc").isNull()), F.min(F.when(~F.col("_td"), F.col("_tc")))).alias("_tc"), F.lit(True).alias("_there"))
        joined = wanted.join(there.withColumnsRenamed(dict(zip(by_t, by_r, strict=True))), by_r, "left")
        bad = joined.filter(F.col("_there").isNull() | F.col("_td") | (F.col("_tc") > F.col("_first")))
        bad = bad.select(*by_r, F.when(F.col("_there").isNull(), "missing").when(F.col("_td"), "deleted").alias("_kind"), "_tc")
        bad = materialize(bad)
        one = F.array(*by_r)
        hits = lookup_join(masked.withColumn("_j", one), bad.select(one.alias("_j"), "_kind", "_tc"), "_j")
        hits = hits.withColumn("_kind", F.coalesce("_kind", F.when(F.col("_tc") > F.col("_c"), "late"))).filter("_kind is not null")
        out.append(named(hits, F.col("_kind")))
    return reduce(DataFrame.unionByName, out) if out else named(refs.limit(0), F.lit(""))


def orphan_references(refs: Sequence[Reference], tables: dict[str, DataFrame]) -> DataFrame:
    """The orphans of several references, in one table."""
    return reduce(DataFrame.unionByName, [orphans(r, tables[r.table], tables[r.target]) for r in refs])


def orphan_report(found: DataFrame, period: str = "month") -> DataFrame:
    """Orphans counted by table, field, kind and period of the referring row (null where it has no time)."""
    return found.groupBy("ref_table", "ref_field", "kind", F.to_date(F.date_trunc(period, F.col("created_at"))).alias("period")).agg(F.count(F.lit(1)).alias("n"))
