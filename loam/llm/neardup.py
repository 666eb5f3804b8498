"""Near-duplicate records: fingerprints in Gray order, a hierarchical index, and exact verification.

1. Each record becomes its set of word runs; records with the same set are one class, represented once.
2. A class gets min-hashes of its set. One bit of each makes a 128-bit fingerprint, and groups of `ROWS` of them make the
   masked patterns of the topmost nodes of the index, on which no difference is allowed: a record lies below one node for
   each of its `bands` patterns. Their number is chosen so that two sets at the threshold share some pattern with probability
   1 - loss; above the threshold the loss falls fast. (Sets at 0.5 differ in a quarter of the fingerprint's bits and unlike ones
   in half, so without such patterns nothing could be pruned before most bits are compared.)
3. Below a pattern, fingerprints are sorted by Gray rank; runs of alike ones are factored into nodes of shared masked bits,
   those into nodes of the next level. The index is descended from the patterns (gray.forest), and groups are left as soon as
   their accumulated differences exceed the radius, which keeps all but `loss` of the pairs at the threshold. Every
   candidate comes out of this descent, whatever the size of its group.
4. A pattern with more than `HOT` rows is cut into blocks of consecutive Gray ranks; each pair of blocks is a task of its
   own, so no task gets an unbounded group, and nothing is dropped.
5. Candidates are verified on their whole sets; a record with many candidates meets them in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.gray import BITS, forest, gray_code, gray_rank, join
from loam.llm.words import WordHashes, distinct_runs, hash_words, mix
from loam.operators.blocks import blocked, expand, pairs_within
from loam.operators.components import connected_components
from loam.session import lookup_join, materialize, semi_join, worker_cache

ROWS = 3
#: Share of the pairs exactly at the threshold that the bands may miss, and again the radius.
LOSS = 0.002
#: Rows of a band key that one task joins; larger ones are cut into blocks of this size.
HOT = 4096
TOP = np.uint64(1 << 63)


@dataclass(frozen=True)
class Plan:
    n: int
    min_words: int
    bands: int
    radius: int

    @property
    def hashes(self) -> int:
        return max(BITS, self.bands * ROWS)


def plan(n: int, threshold: float, min_words: int, loss: float) -> Plan:
    """Number of bands and radius for a Jaccard threshold."""
    t = min(max(threshold, 0.05), 0.99)
    bands = max(1, math.ceil(math.log(loss) / math.log(1 - t**ROWS)))
    p = (1 - t) / 2
    z = 3.1
    return Plan(n, min_words, bands, math.ceil(BITS * p + z * math.sqrt(BITS * p * (1 - p))))


def _texts(batch: pa.RecordBatch, columns: Sequence[str]) -> list[str]:
    parts = [batch.column(c).to_pylist() for c in columns]
    return [" ".join(x or "" for x in row) for row in zip(*parts, strict=True)]


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned order as signed order."""
    return (x ^ TOP).view(np.int64)


def sketches(columns: Sequence[str], p: Plan):
    """A function over Arrow batches: a row's set hash, size, Gray rank and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache().setdefault("words", WordHashes())
        k = np.arange(1, p.hashes + 1, dtype=np.uint64)
        xor, odd = mix(k), mix(k + np.uint64(1 << 32)) | np.uint64(1)
        num = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                h, counts = hash_words(_texts(batch, columns), words)
                s, doc = distinct_runs(h, counts, p.n)
                enough = counts >= p.min_words
                s, doc = s[enough[doc]], doc[enough[doc]]
                there, first, size = np.unique(doc, return_index=True, return_counts=True)
                sizes = np.zeros(batch.num_rows, np.int32)
                sizes[there] = size
                full = {c: np.zeros(batch.num_rows, np.uint64) for c in ("set_hi", "set_lo", "rank_hi", "rank_lo")}
                bands = np.zeros((batch.num_rows, p.bands), np.uint64)
                if len(there):
                    full["set_hi"][there] = np.add.reduceat(mix(s + np.uint64(1)), first)
                    full["set_lo"][there] = np.add.reduceat(mix(s ^ np.uint64(0x5851F42D4C957F2D)), first)
                    least = np.empty((p.hashes, len(there)), np.uint64)
                    for i in range(p.hashes):
                        np.minimum.reduceat((s ^ xor[i]) * odd[i], first, out=least[i])
                    bits = (mix(least[:BITS]) >> np.uint64(63)).astype(np.uint8)
                    packed = np.packbits(bits.T.copy(), axis=1).view(">u8").astype(np.uint64)
                    full["rank_hi"][there], full["rank_lo"][there] = gray_rank(packed[:, 0], packed[:, 1])
                    for b in range(p.bands):
                        key = np.full(len(there), b, np.uint64)
                        for row in least[b * ROWS : (b + 1) * ROWS]:
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
                        bands[there, b] = key
                lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, p.bands, dtype=np.int32), pa.array(bands.ravel().view(np.int64)))
                nums = num + np.arange(batch.num_rows)
                num += batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nums, pa.int64()), batch.column("id"), *[pa.array(full[c].view(np.int64)) for c in ("set_hi", "set_lo")], pa.array(sizes), *[pa.array(_signed(full[c])) for c in ("rank_hi", "rank_lo")], lists],
                    ["num", "id", "set_hi", "set_lo", "size", "rank_hi", "rank_lo", "bands"],
                )

    return run


SKETCH = "num long, id string, set_hi long, set_lo long, size int, rank_hi long, rank_lo long, bands array<long>"
FOUND = "a long, b long, key long, pos long, rank_hi long, rank_lo long"


def _codes(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return gray_code(hi.view(np.uint64) ^ TOP, lo.view(np.uint64) ^ TOP)


def _group_pairs(key: np.ndarray, num: np.ndarray, hi: np.ndarray, lo: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius of rows with the same key; rows are sorted by key and Gray rank."""
    hi, lo = _codes(hi, lo)
    several = np.append(False, key[1:] == key[:-1])
    several[:-1] |= several[1:]  # a pattern of one row has no tree
    at = np.flatnonzero(several)
    new = key[at][1:] != key[at][:-1]
    i, j = forest(np.append(0, np.cumsum(new)) if len(at) else at, hi[at], lo[at], radius)
    a, b = num[at[i]], num[at[j]]
    return np.minimum(a, b), np.maximum(a, b)


def bucket_pairs(radius: int, hot: int):
    """A function over batches of (key, num, ranks), sorted by key and rank: candidate pairs, and the rows of hot keys with their position."""

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none, none, none], ["a", "b", "key", "pos", "rank_hi", "rank_lo"])

    def later(rows: list[np.ndarray], pos: int) -> pa.RecordBatch:
        key, num, hi, lo = rows
        return pa.RecordBatch.from_arrays([pa.array(num), pa.nulls(len(num), pa.int64()), pa.array(key), pa.array(np.arange(pos, pos + len(num))), pa.array(hi), pa.array(lo)], ["a", "b", "key", "pos", "rank_hi", "rank_lo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        hot_key, pos = None, 0
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("key", "num", "rank_hi", "rank_lo")]
            if hot_key is not None:
                n = int(np.searchsorted(rows[0], hot_key, "right"))
                if n:
                    yield later([x[:n] for x in rows], pos)
                    pos += n
                    rows = [x[n:] for x in rows]
                if not len(rows[0]):
                    continue
                hot_key = None
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
                kept = None
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            if cut:
                yield pairs(*_group_pairs(*[x[:cut] for x in rows], radius))
            kept = [x[cut:] for x in rows]
            if len(kept[0]) > hot:
                yield later(kept, 0)
                hot_key, pos, kept = kept[0][0], len(kept[0]), None
        if kept is not None and len(kept[0]):
            yield pairs(*_group_pairs(*kept, radius))

    return run


def block_pairs(radius: int):
    """A function over one pair of blocks of a hot key; rows carry the number of their block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("rank_hi", "ascending"), ("rank_lo", "ascending")])
        block, num, hi, lo = [table.column(c).to_numpy() for c in ("block", "num", "rank_hi", "rank_lo")]
        hi, lo = _codes(hi, lo)
        n = int(np.searchsorted(block, block[0], "right"))
        i, j = join((hi, lo), None, radius) if n == len(num) else join((hi[:n], lo[:n]), (hi[n:], lo[n:]), radius)
        a, b = num[i], num[j if n == len(num) else j + n]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def grams(columns: Sequence[str], n: int):
    """A function over batches of (num, texts): num and the sorted distinct runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache().setdefault("words", WordHashes())
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                s, doc = distinct_runs(*hash_words(_texts(batch, columns), words), n)
                ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("num"), pa.ListArray.from_arrays(pa.array(ends), pa.array(s.view(np.int64)))], ["num", "grams"])

    return run


@dataclass(frozen=True)
class NearDuplicates:
    """members: (id, class_id) of the records that share their whole set with another one. pairs: (a, b, similarity) of classes, named by
    their least id, a < b. A class that members doesn't name is the one record of that id."""

    records: DataFrame
    members: DataFrame
    pairs: DataFrame


def near_duplicates(df: DataFrame, id_column: str, columns: Sequence[str], threshold: float = 0.8, n: int = 5, min_words: int = 0, loss: float = LOSS, hot: int = HOT) -> NearDuplicates:
    """Classes of records whose sets of runs of n words have a Jaccard similarity of at least the threshold.

    The text of a record is its columns joined by a space, null as empty. Records with fewer than n (or min_words) words
    have no set and are similar to nothing. Rows without an id can't be reported and are left out; a row that comes
    twice counts once. Other columns are ignored. An empty table gives empty results."""
    p = plan(n, threshold, min_words, loss)
    source = df.filter(F.col(f"`{id_column}`").isNotNull()).select(F.col(f"`{id_column}`").cast("string").alias("id"), *[F.col(f"`{c}`").cast("string").alias(f"t{i}") for i, c in enumerate(columns)])
    texts = [f"t{i}" for i in range(len(columns))]
    records = materialize(source.mapInArrow(sketches(texts, p), SKETCH))
    sets = records.filter("size > 0")

    same = ["set_hi", "set_lo"]
    copies = sets.groupBy(*same).agg(F.min(F.struct("id", "num")).alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = materialize(copies.select(*same, F.col("rep.id").alias("class_id"), F.col("rep.num").alias("rep_num")))
    n_copies = copies.count()
    classed = lookup_join(sets, copies, same, "left", n_copies)
    members = lookup_join(sets.select("id", *same), copies, same, "inner", n_copies).select("id", "class_id").distinct()
    reps = classed.filter("rep_num is null or rep_num = num")

    table = reps.select("num", "rank_hi", "rank_lo", F.explode("bands").alias("key")).select("key", "num", "rank_hi", "rank_lo")
    found = materialize(table.repartition("key").sortWithinPartitions("key", "rank_hi", "rank_lo").mapInArrow(bucket_pairs(p.radius, hot), FOUND))
    pairs = found.filter("key is null").select("a", "b")
    later = found.filter("key is not null").select("key", F.col("a").alias("num"), F.floor(F.col("pos") / hot).cast("int").alias("block"), "rank_hi", "rank_lo")
    blocks = later.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    if blocks.limit(1).count():
        each = later.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        each = each.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "num", "block", "rank_hi", "rank_lo")
        pairs = pairs.unionByName(each.groupBy("key", "p", "q").applyInArrow(block_pairs(p.radius), "a long, b long"))
    pairs = materialize(pairs.distinct())

    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("num")).distinct())
    n_wanted = wanted.count()
    ids = materialize(semi_join(records.select("num", "id"), wanted, "num", n_wanted))
    bodies = lookup_join(source, ids, "id", "inner", n_wanted).dropDuplicates(["num"]).select("num", *texts)
    sets_of = bodies.mapInArrow(grams(texts, n), "num long, grams array<long>")
    sets_of = materialize(sets_of.join(ids, "num"))
    scored = _meet(_meet(pairs, sets_of, "b", "a"), sets_of, "a", "b").withColumn("s", F.size(F.array_intersect("ga", "gb")))
    similarity = F.col("s") / (F.size("ga") + F.size("gb") - F.col("s"))
    scored = scored.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), similarity.alias("similarity"))
    return NearDuplicates(records.select("id"), members, scored.filter((F.col("similarity") >= threshold) & (F.col("a") < F.col("b"))))


def _meet(pairs: DataFrame, sets: DataFrame, end: str, other: str) -> DataFrame:
    """Pairs with the set and id (g.., i..) of one end. An end with many pairs is met in blocks of them, so its set doesn't gather them all in one task."""
    rows, many = blocked(pairs, end, other)
    there = sets.select(F.col("num").alias(end), F.col("grams").alias(f"g{end}"), F.col("id").alias(f"i{end}"))
    there = lookup_join(there, many, end, "left").withColumn("own", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1))).drop("cuts")
    return rows.drop("cuts").join(there, [end, "own"]).drop("own")


def expand_pairs(found: NearDuplicates) -> DataFrame:
    """All pairs of records (id_a < id_b), those within a class included, as the definition of a found pair asks. The result is quadratic in a class; a large class is opened in blocks, each two of them by a task."""
    m = found.members
    within = pairs_within(m, "class_id", "id").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    across = expand(found.pairs.select("a", "b"), m.select(F.col("class_id").alias("a"), F.col("id").alias("xa")), "a", "xa")
    across = expand(across, m.select(F.col("class_id").alias("b"), F.col("id").alias("xb")), "b", "xb")
    x, y = F.coalesce("xa", "a"), F.coalesce("xb", "b")
    across = across.select(F.least(x, y).alias("id_a"), F.greatest(x, y).alias("id_b"))
    return within.unionByName(across)


def groups(found: NearDuplicates) -> DataFrame:
    """One row a record: (id, class_id: of its whole copies, group_id: of all that is linked to it, n_links: of its class to other classes)."""
    found = NearDuplicates(found.records, found.members, materialize(found.pairs))
    ends = found.pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    labels = connected_components(found.pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rows = found.records.distinct().join(found.members, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    rows = rows.join(ends, "class_id", "left").join(labels.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    return rows.select("id", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


__all__ = ["near_duplicates", "expand_pairs", "groups", "NearDuplicates"]
