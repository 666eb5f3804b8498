"""Differences between two copies of a dataset, found with invertible Bloom lookup tables.

Every row becomes an element (key hash, row hash). Each side adds its elements to the cells of the bucket that the key
falls in; the sides are subtracted and each bucket is peeled, which reveals the keys whose rows differ. Only rows of
those keys are fetched and compared field by field. What is shuffled is the cells, whose number follows the number of
differences, not the rows. The cells hold sums rather than XORs, so rows delivered several times need no deduplication
beforehand: a surplus copy only reveals its key, and the comparison settles it. A bucket that can't be peeled is
compared directly, so the result is exact (up to a collision of two 64-bit hashes).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.session import BROADCAST_ROWS, materialize, null_safe_hash, semi_join

HASHES = 3
#: Cells of a bucket, and elements that a bucket is planned for.
CELLS, PLANNED = 120, 44
#: Levels of the estimator, and cells of each.
LEVELS, LEVEL_CELLS = 24, 240
#: The estimate is taken so many times, to allow for its error.
MARGIN = 1.3
SEED = 42  # Spark's seed of xxhash64
LOW, CHECK = (1 << 32) - 1, (1 << 31) - 1
SUMS = ("n", "key_hi", "key_lo", "row_hi", "row_lo", "chk")


def element_hash(key: int, row: int) -> int:
    """Spark's xxhash64(key, row), signed."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", row), xxhash.xxh64_intdigest(struct.pack("<q", key), SEED))
    return h - (1 << 64) if h >> 63 else h


def cell_positions(h: int, cells: int) -> list[int]:
    """One cell in each of HASHES sub-tables, from 20 bits of the hash each."""
    part = cells // HASHES
    return [j * part + ((h >> (20 * j)) & 0xFFFFF) % part for j in range(HASHES)]


def _cells(elements: DataFrame, group: Column, cells: int) -> DataFrame:
    """Sum the elements (key, row, sign) into cells, by group; Spark sums up in each task before it shuffles."""
    part = cells // HASHES
    h = F.xxhash64("key", "row")
    at = F.array(*[(F.pmod(F.shiftright("h", 20 * j).bitwiseAND(F.lit(0xFFFFF)), F.lit(part)) + j * part).cast("int") for j in range(HASHES)])
    sums = {
        "n": F.col("sign"),
        "key_hi": F.shiftright("key", 32) * F.col("sign"),
        "key_lo": F.col("key").bitwiseAND(F.lit(LOW)) * F.col("sign"),
        "row_hi": F.shiftright("row", 32) * F.col("sign"),
        "row_lo": F.col("row").bitwiseAND(F.lit(LOW)) * F.col("sign"),
        "chk": F.col("h").bitwiseAND(F.lit(CHECK)) * F.col("sign"),
    }
    rows = elements.withColumn("h", h).withColumn("grp", group).select("grp", F.explode(at).alias("cell"), *[v.alias(k) for k, v in sums.items()])
    return rows.groupBy("grp", "cell").agg(*[F.sum(k).alias(k) for k in SUMS])


def peel(cells: pd.DataFrame, size: int) -> tuple[dict[tuple[int, int], int], bool]:
    """Elements with their surplus count on the first side; whether every cell came out empty."""
    table = {int(c): list(map(int, v)) for c, *v in cells[["cell", *SUMS]].itertuples(index=False)}
    found: dict[tuple[int, int], int] = {}
    stack = list(table)
    while stack:
        at = stack.pop()
        v = table.get(at)
        if not v or not v[0] or any(x % v[0] for x in v[1:]):
            continue
        n = v[0]
        key, row = (v[1] // n << 32) + v[2] // n, (v[3] // n << 32) + v[4] // n
        if not all(-(1 << 63) <= x < 1 << 63 for x in (key, row)):
            continue
        h = element_hash(key, row)
        places = cell_positions(h, size)
        if v[5] != n * (h & CHECK) or at not in places:
            continue
        found[key, row] = found.get((key, row), 0) + n
        for p in places:
            w = table.setdefault(p, [0] * len(SUMS))
            for i, x in enumerate((n, *v[1:])) if p != at else ():
                w[i] -= x
            stack.append(p)
        table[at] = [0] * len(SUMS)
    return found, not any(any(v) for v in table.values())


def _peel_bucket(cells: pd.DataFrame) -> pd.DataFrame:
    bucket = int(cells["grp"].iloc[0])
    found, whole = peel(cells, CELLS)
    keys = sorted({k for k, _ in found}) if whole else []
    return pd.DataFrame({"key": pd.Series(keys if whole else [None], dtype="Int64"), "bucket": pd.Series([bucket] * (len(keys) if whole else 1), dtype="Int64")})


def estimate_differences(elements: DataFrame) -> int:
    """Number of elements on one side only, by strata: level i holds 2^-(i+1) of the keys. At most LEVELS * LEVEL_CELLS rows reach the driver."""
    level = F.least(F.bit_count(F.xxhash64("key", F.lit(7)).bitwiseAND(-F.xxhash64("key", F.lit(7))) - 1), F.lit(LEVELS - 1))
    # the lowest bit by itself, less one, has as many ones as the hash has trailing zeros; the least number has no negative
    table = _cells(elements.filter(F.xxhash64("key", F.lit(7)) > F.lit(-(1 << 63))), level, LEVEL_CELLS).toPandas()
    count = 0
    for i in reversed(range(LEVELS)):
        found, whole = peel(table[table["grp"] == i], LEVEL_CELLS)
        if not whole:
            return max(count, 1) * 2 ** (i + 1)
        count += len(found)
    return count


def differing_keys(local: DataFrame, remote: DataFrame, key: str, fields: Sequence[str], order: str | None = None) -> tuple[DataFrame, int]:
    """Table of (key: hash of a differing key, bucket), with a null key where a whole bucket has to be compared; and the number of buckets."""
    hashed = [key, *dict.fromkeys([*fields, *([order] if order else [])])]

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(null_safe_hash([key]).alias("key"), null_safe_hash(hashed).alias("row"), F.lit(sign).cast("long").alias("sign"))

    elements = side(local, 1).unionByName(side(remote, -1))
    buckets = max(1, math.ceil(MARGIN * estimate_differences(elements) / PLANNED))
    cells = _cells(elements, F.pmod(F.xxhash64("key", F.lit(11)), F.lit(buckets)), CELLS)
    cells = cells.filter(" or ".join(f"{c} != 0" for c in SUMS))
    # peeling is work of a processor and its input small: partitions by number of buckets, not by bytes
    parts = max(1, min(buckets // 8, 4 * local.sparkSession.sparkContext.defaultParallelism))
    cells = cells.repartition(parts, "grp")
    return materialize(cells.groupBy("grp").applyInPandas(_peel_bucket, "key long, bucket long")), buckets


def replica_diff(local: DataFrame, remote: DataFrame, key: str, fields: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows (key, diff): `only_local`, `only_remote`, or the name of a field whose values differ, one row a field.

    Values compare exactly; null equals only null, for keys too, so all rows without a key are one key. Of several rows
    of a key, the one with the latest `order` counts (null is the earliest; among equal ones the greatest values of
    `fields`, in their order). Other columns of either side, also clashing ones, are ignored. Empty sides are allowed."""
    fields = list(fields)
    found, buckets = differing_keys(local, remote, key, fields, order)
    keys = found.filter("key is not null").select(F.col("key").alias("_key"))
    failed = found.filter("key is null").select(F.col("bucket").alias("_bucket"))
    n_failed = failed.count()
    n_keys = keys.count()

    def fetched(df: DataFrame, side: str) -> DataFrame:
        kept = list(dict.fromkeys([key, *fields, *([order] if order else [])]))
        rows = df.select(*[F.col(f"`{c}`") for c in kept], null_safe_hash([key]).alias("_key"))
        parts = semi_join(rows, keys, "_key", n_keys, BROADCAST_ROWS)
        if n_failed:
            by_bucket = rows.withColumn("_bucket", F.pmod(F.xxhash64("_key", F.lit(11)), F.lit(buckets)))
            parts = parts.unionByName(semi_join(by_bucket, failed, "_bucket", n_failed, BROADCAST_ROWS).drop("_bucket"))
        state = F.struct(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate([*([order] if order else []), *fields])])
        return parts.select(F.col(f"`{key}`").alias("k"), F.lit(side).alias("side"), state.alias("state"))

    both = fetched(local, "l").unionByName(fetched(remote, "r"))
    latest = both.groupBy("k").agg(*[F.max(F.when(F.col("side") == s, F.col("state"))).alias(s) for s in "lr"])
    shift = 1 if order else 0
    differs = [F.when(~F.col(f"l.v{i + shift}").eqNullSafe(F.col(f"r.v{i + shift}")), F.lit(c)) for i, c in enumerate(fields)]
    diffs = F.when(F.col("r").isNull(), F.array(F.lit("only_local"))).when(F.col("l").isNull(), F.array(F.lit("only_remote"))).otherwise(F.array_compact(F.array(*differs)))
    return latest.select(F.col("k").alias(key), F.explode(diffs).alias("diff"))


def diff_report(diffs: DataFrame) -> DataFrame:
    """Number of keys by kind of difference."""
    return diffs.groupBy("diff").agg(F.count(F.lit(1)).alias("n"))


