"""Mixing sources to target weights by Poisson replication.

A record of source s comes out as often as a Poisson variable of mean lambda_s says, cut off at the most repeats; the
variable is the inverse of the distribution at a uniform number hashed from the record's id and the seed, so it is the
same in every run and on every machine. lambda_s is set so that the source's tokens, counted over the real records,
meet its share: as the number of copies only grows with lambda, the tokens by slices of the uniform number (at most
`BINS` a source) are all that has to be known for that; each source's mean is found by a task of its own. The copies are then put into a global random order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.tokens import token_count
from loam.session import lookup_join, materialize

BINS = 4096
SEED = 17


def source_name(column: Column) -> Column:
    """A source in one spelling: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s-]+", "_")


def at_least(mean: float, most: int) -> list[float]:
    """Probabilities that a Poisson variable is at least 1, 2, ..., most."""
    if math.isinf(mean):
        return [1.0] * most
    below, term, out = 0.0, math.exp(-mean), []
    for j in range(1, most + 1):
        below += term
        term *= mean / j
        out.append(max(0.0, 1.0 - below))
    return out


def copies(u: float, probabilities: list[float]) -> int:
    """The inverse of the distribution, cut off."""
    return sum(u < p for p in probabilities)


def calibrate(slices: dict[int, int], wanted: float, most: int) -> float:
    """The mean for which the tokens, given by slice of the uniform number, come nearest to what is wanted; infinite where all have to be used at most."""
    def tokens(mean: float) -> int:
        p = at_least(mean, most)
        return sum(n * copies((b + 0.5) / BINS, p) for b, n in slices.items())

    if wanted >= most * sum(slices.values()):
        return math.inf
    low, high = 0.0, 1.0
    while tokens(high) < wanted and high < 1e6:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if tokens(middle) < wanted else (low, middle)
    return min((low, high), key=lambda x: abs(tokens(x) - wanted))


def _mean(total: float):
    """A function over the slices of one source: its mean number of copies and the probabilities of at least 1, 2, ... copies."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        most = int(rows["max_repeats"].iloc[0])
        mean = calibrate(dict(zip(rows["b"].tolist(), rows["n"].tolist(), strict=True)), float(rows["target_share"].iloc[0]) * total, most)
        return pd.DataFrame({"source": [rows["source"].iloc[0]], "mean_copies": [mean], "p": [at_least(mean, most)]})

    return run


@dataclass(frozen=True)
class Mix:
    """rows: (mix_order, id, copy_no, source, n_tokens, text), in the order of mix_order. report: a row a source."""

    rows: DataFrame
    report: DataFrame


def mix_sources(df: DataFrame, targets: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", total_tokens: int | None = None, seed: int = SEED, path: str | None = None) -> Mix:
    """Mix the records of df to the shares of targets (source, target_share, max_repeats), measured in tokens.

    total_tokens: tokens of the mix; by default the greatest total at which every source that has records meets its share
    within its repeats. A source that can't reach its part of the total is used max_repeats times throughout. Sources
    compare in one spelling (source_name). Records without a text, of no source or of one without a target aren't mixed;
    the report has such sources with a target of 0, and targets without records with an actual share of 0. Records of equal id are
    copied equally often, each by itself; null ids count as one id. Null or negative shares and repeats count as 0; of a
    source's several targets the greatest holds. Other columns are ignored."""
    goal = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).cast("double").alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).cast("int").alias("max_repeats"))
    goal = materialize(goal.filter("source is not null"))
    uniform = F.xxhash64(F.lit(seed), F.col("id")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    records = df.select(F.col(f"`{id_column}`").alias("id"), source_name(F.col(f"`{source_column}`")).alias("source"), F.col(f"`{text_column}`").cast("string").alias("text"))
    records = records.filter("text is not null and text != ''").withColumn("n_tokens", token_count(F.col("text"), path)).withColumn("u", uniform)
    records = materialize(records)
    wanted = goal.filter("target_share > 0 and max_repeats > 0")
    n_wanted = wanted.count()
    slices = records.groupBy("source", F.floor(F.col("u") * BINS).alias("b")).agg(F.sum("n_tokens").alias("n"))
    slices = materialize(slices.join(wanted, "source"))
    if total_tokens is None:
        sizes = slices.groupBy("source").agg(F.sum("n").alias("n"), F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).filter("n > 0")
        total_tokens = sizes.agg(F.min(F.col("m") * F.col("n") / F.col("s"))).first()[0] or 0
    parameters = materialize(slices.groupBy("source").applyInPandas(_mean(float(total_tokens)), "source string, mean_copies double, p array<double>"))
    counted = lookup_join(records, parameters, "source", rows=n_wanted).withColumn("copies", F.size(F.filter("p", lambda p: F.col("u") < p))).filter("copies > 0")

    exploded = counted.select("id", "source", "n_tokens", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    ordered = exploded.withColumn("mix_order", F.xxhash64(F.lit(seed + 1), "id", "copy_no")).repartitionByRange("mix_order").sortWithinPartitions("mix_order", "id", "copy_no")
    used = counted.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("n_rows"))
    there = records.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("n_tokens").alias("largest"))
    wanted = goal.join(parameters.select("source", "mean_copies"), "source", "left")
    report = there.join(wanted, there["source"].eqNullSafe(wanted["source"]), "full").select(F.coalesce(there["source"], wanted["source"]).alias("source"), "source_tokens", "n_docs", "largest", "target_share", "max_repeats", "mean_copies").join(used, "source", "left")
    report = report.fillna(0, ["source_tokens", "n_docs", "largest", "target_share", "max_repeats", "mixed_tokens", "n_rows"])
    whole = used.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = report.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0))).drop("all_tokens")
    return Mix(ordered.select("mix_order", F.col("id").alias(id_column), "copy_no", "source", "n_tokens", "text"), report)
