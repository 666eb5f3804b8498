"""Joins within groups of any size: a group is cut into blocks, and each pair of blocks is a join key of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.session import lookup_join, materialize

BLOCK = 500


def blocked(df: DataFrame, key: str | Sequence[str], item: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """df with own (the row's block) and cuts (the number of blocks of its group, one for a group of up to `block` rows); and the groups of several blocks (key, cuts)."""
    keys = [key] if isinstance(key, str) else list(key)
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts")).filter("cuts > 1")
    sizes = materialize(sizes)
    rows = lookup_join(df, sizes, keys, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    return rows.withColumn("own", F.pmod(F.xxhash64(item), F.col("cuts")).cast("int")), sizes


def _each(name: str):
    return F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias(name)


def pairs_within(df: DataFrame, key: str | Sequence[str], item: str, block: int = BLOCK) -> DataFrame:
    """(key, a, b), a < b: all pairs of different items of a group; no join key has more than the product of two blocks. Rows (key, item) are distinct."""
    keys = [key] if isinstance(key, str) else list(key)
    rows, _ = blocked(df.select(*keys, item), keys, item, block)
    left = rows.select(*keys, F.col(item).alias("a"), F.col("own").alias("i"), _each("j"))
    right = rows.select(*keys, F.col(item).alias("b"), F.col("own").alias("j"), _each("i"))
    return left.join(right, [*keys, "i", "j"]).filter("a < b").select(*keys, "a", "b")


def expand(left: DataFrame, members: DataFrame, key: str, item: str, block: int = BLOCK) -> DataFrame:
    """Left join of rows with all members (key, item) of their group; a large group's members are met block by block, by different tasks."""
    rows, sizes = blocked(members.select(key, item), key, item, block)
    wide = lookup_join(left, sizes, key, "left").withColumn("own", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1))).drop("cuts")
    return wide.join(rows.select(key, "own", item), [key, "own"], "left").drop("own")
