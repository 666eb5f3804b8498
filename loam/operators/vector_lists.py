"""Lists of alike vectors, on which searches for neighbours run: an inverted file of one or two levels.

1. Spherical k-means on a bounded sample (an eighth of the vectors, at least `SAMPLE` and at most `MOST_SAMPLE`, the first by
   hash of the id), fitted by a task, gives at most `LISTS` lists.
2. Small lists that lie together are packed into parts of about `PART` vectors. A list of more than two parts is split:
   k-means on a bounded sample of its own vectors gives up to `FINE` finer lists, each a part. Two levels keep parts at
   their size up to some LISTS x FINE x PART / 2 vectors, about 10^10. A finer list that can't be cut along its vectors
   (its sample says it has over four parts) is cut into chunks by hash.
3. A vector asks in its nearest list and in the `PROBES` nearest ones whose centroid is less similar than the best by at most
   `MARGIN`. It travels once to each part in which it asks, so the copies of a vector are bounded, whatever the number of
   vectors. Among all, it also answers in every part to which it travels: two alike vectors meet if any of their lists is the
   same. Where the sample has none of a small group of alike vectors, which is usual with millions of vectors, its members
   are spread over several lists by chance; answering in the nearest list only would lose many of them. Rows that answer
   queries lie in their nearest list only.

The centroids of the first level travel with the tasks (at most 8192 of them); those of the second lie in the shared
folder, a file for each split list, and rows come to them sorted by list.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.blocks import expand, pairs_within
from loam.session import lookup_join, materialize, read_files

#: Vectors that the centroids of a split list are fitted on at most, and those of the first level at least and at most; most lists of the first level and of a split list, iterations.
SAMPLE, MOST_SAMPLE, LISTS, FINE, ITERATIONS = 16384, 65536, 8192, 4096, 6
#: Lists are so many times the square root of the vectors' number, and hold so many vectors on average at least.
DENSITY, LEAST = 4, 64
#: Lists that a vector probes, and how much less similar their centroid may be than the best one; the latter where rows answer in their nearest list only.
PROBES, MARGIN, QUERY_MARGIN = 8, 0.07, 0.1
#: Lists that it probes at most in its own part, where nothing has to travel.
OWN_PROBES = 24
#: Vectors of a part.
PART = 4000
SEED = 20240229
ROUTED = "part int, home int, id string, vec binary, probes array<int>"


def usable(vectors: np.ndarray) -> np.ndarray:
    """Rows of finite numbers that aren't all zero."""
    return np.isfinite(vectors).all(1) & (vectors != 0).any(1)


def unit(vectors: np.ndarray, kind: type = np.float32) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(kind)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of exactly dims floats as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dims)


def narrow(vectors: np.ndarray) -> np.ndarray:
    """In half precision if that holds every number exactly, as it does for vectors that were computed in it."""
    with np.errstate(over="ignore"):
        half = vectors.astype(np.float16)
    return half if (half.astype(np.float32) == vectors).all() else vectors


def packed(vectors: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in narrow(vectors)], pa.binary())


def wide(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a column that `packed` wrote."""
    rows = column.to_pylist()
    if len({len(x) for x in rows}) == 1:
        return np.frombuffer(b"".join(rows), np.float16 if len(rows[0]) == 2 * dims else np.float32).reshape(-1, dims).astype(np.float32)
    return np.stack([np.frombuffer(x, np.float16 if len(x) == 2 * dims else np.float32).astype(np.float32) for x in rows]) if rows else np.empty((0, dims), np.float32)


def fit_centroids(vectors: np.ndarray, lists: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means over unit vectors: centroids and the number of vectors of each. Empty lists restart from the worst represented vectors."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(vectors)))
    centroids = vectors[rng.choice(len(vectors), lists, replace=False)].copy()
    for _ in range(ITERATIONS):
        own, best = _nearest(vectors, centroids)
        counts = np.bincount(own, minlength=lists)
        order = np.argsort(own, kind="stable")
        there = np.flatnonzero(counts)
        sums = np.add.reduceat(vectors[order], np.append(0, np.cumsum(counts[there])[:-1]), axis=0)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids[there] = sums / np.where(norms > 0, norms, 1)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            centroids[empty] = vectors[np.argsort(best, kind="stable")[: len(empty)]]
    return centroids, np.bincount(_nearest(vectors, centroids)[0], minlength=lists)


def _nearest(vectors: np.ndarray, centroids: np.ndarray, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and its similarity, in slices that bound the memory."""
    own, best = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.float32)
    for at in range(0, len(vectors), rows):
        sims = vectors[at : at + rows] @ centroids.T
        own[at : at + rows], best[at : at + rows] = sims.argmax(1), sims.max(1)
    return own, best


def pack_lists(centroids: np.ndarray, weights: np.ndarray, target: float) -> tuple[np.ndarray, int]:
    """The part of each list, and the number of parts: lists are halved along their main direction until a half weighs at most the target or is one list."""
    of = np.zeros(len(weights), np.int32)
    parts, stack = 0, [np.arange(len(weights))] if len(weights) else []
    while stack:
        ids = stack.pop()
        if len(ids) == 1 or weights[ids].sum() <= target:
            of[ids], parts = parts, parts + 1
            continue
        c = centroids[ids].astype(np.float64)
        c -= c.mean(0)
        axis = np.linalg.svd(c, full_matrices=False)[2][0]
        ids = ids[np.argsort(c @ axis, kind="stable")]
        run = np.cumsum(weights[ids] + 1e-9)
        cut = min(max(1, int(np.searchsorted(run, run[-1] / 2))), len(ids) - 1)
        stack += [ids[:cut], ids[cut:]]
    return of, parts


@dataclass(frozen=True)
class Lists:
    """centroids of the first level; part: of each list, -1 where it is split; base: the first part of a split list; files: those of its finer centroids."""

    dims: int
    centroids: np.ndarray
    part: np.ndarray
    base: np.ndarray
    files: dict[int, list[str]] = field(default_factory=dict)
    probes: int = PROBES
    margin: float = MARGIN


def _split_sample(dims: int, centroids: np.ndarray, shares: np.ndarray):
    """A function over batches of (id, vec): the sampled vectors of lists that are split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                v = matrix(batch.column("vec"), dims)
                ok = np.flatnonzero(usable(v))
                if not len(ok):
                    continue
                v, h = v[ok], batch.column("h").to_numpy()[ok]
                own = (unit(v) @ centroids.T).argmax(1)
                take = (h % (1 << 30)) < shares[own] * (1 << 30)
                yield pa.RecordBatch.from_arrays([pa.array(own[take].astype(np.int32)), packed(v[take])], ["list", "vec"])

    return run


def _split_fit(dims: int, weights: dict[int, float], part: int):
    """A function over the sample of one list: its finer centroids, with the number of parts of each."""

    def run(table: pa.Table) -> pa.Table:
        which = table.column("list")[0].as_py()
        v = unit(wide(table.column("vec"), dims))
        v = v[np.lexsort(v.T[:8])]
        c, counts = fit_centroids(v, min(FINE, math.ceil(2 * weights[which] / part), max(1, len(v) // 4)))
        chunks = np.maximum(1, np.ceil(counts / len(v) * weights[which] / (4 * part))).astype(np.int32)
        return pa.table({"list": pa.array([which] * len(c), pa.int32()), "chunks": chunks, "vec": pa.array([x.tobytes() for x in c], pa.binary())})

    return run


def _pack_sample(dims: int):
    """A function over batches of (id, vec): the usable ones, unit length not yet, vectors packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("vec"), dims)
                ok = np.flatnonzero(usable(v))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ok)), packed(v[ok])], ["id", "vec"])

    return run


def _fit_sample(dims: int, lists: int):
    """A function over the whole sample: the centroids of the first level, the number of vectors of each, and that of the sample."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("id").column("vec")
        del table
        v = np.concatenate([unit(wide(rows.slice(at, 4096), dims)) for at in range(0, len(rows), 4096)])
        c, counts = fit_centroids(v, max(1, min(lists, max(1, len(v) // 8))))
        return pa.table({"i": pa.array(np.arange(len(c)), pa.int32()), "n": pa.array(counts, pa.int64()), "sample": pa.array(np.full(len(c), len(v)), pa.int64()), "vec": pa.array([x.tobytes() for x in c], pa.binary())})

    return run


def _hash() -> F.Column:
    return F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1))


def fit_lists(rows: DataFrame, n: int, dims: int, lists: int | None = None, part: int = PART, most: int = LISTS, probes: int = PROBES, margin: float = MARGIN) -> Lists | None:
    """Lists for the n rows (id, vec: array of floats); None if no vector of the sample is usable."""
    hashed = rows.withColumn("h", _hash())
    size = min(MOST_SAMPLE, max(SAMPLE, n // 8))
    rate = min(1.0, 1.1 * size / max(n, 1))
    sample = hashed.filter(F.col("h") % F.lit(1 << 30) < F.lit(int(rate * (1 << 30)))).orderBy("h", "id").limit(size).select("id", "vec")
    wanted = lists or round(min(DENSITY * math.sqrt(n), n / LEAST))
    fitted = sample.mapInArrow(_pack_sample(dims), "id string, vec binary").groupBy().applyInArrow(_fit_sample(dims, min(wanted, most)), "i int, n long, sample long, vec binary").toArrow().sort_by("i")
    if not len(fitted):
        return None
    centroids = np.frombuffer(b"".join(fitted.column("vec").to_pylist()), np.float32).reshape(-1, dims)
    weights = (fitted.column("n").to_numpy() + 0.5) * (n / fitted.column("sample")[0].as_py())
    heavy = np.flatnonzero(weights > 2 * part)
    light = np.flatnonzero(weights <= 2 * part)
    of, parts = pack_lists(centroids[light], weights[light], part)
    place, base = np.full(len(weights), -1, np.int32), np.full(len(weights), -1, np.int32)
    place[light] = of
    if not len(heavy):
        return Lists(dims, centroids, place, base, {}, probes, margin)
    shares = np.zeros(len(weights))
    shares[heavy] = np.minimum(1.0, SAMPLE / weights[heavy])
    picked = hashed.select("vec", "h").mapInArrow(_split_sample(dims, centroids, shares), "list int, vec binary")
    fine = materialize(picked.groupBy("list").applyInArrow(_split_fit(dims, {int(i): float(weights[i]) for i in heavy}, part), "list int, chunks int, vec binary"), partition_by=["list"])
    files: dict[int, list[str]] = {}
    for name in sorted(fine.inputFiles()):
        files.setdefault(int(name.rsplit("/list=", 1)[1].split("/")[0]), []).append(name)
    for which, total in sorted((r["list"], r["n"]) for r in fine.groupBy("list").agg(F.sum("chunks").alias("n")).collect()):
        base[which], parts = parts, parts + total
    for which in heavy[base[heavy] < 0]:  # heavy by the estimate, but without a row
        place[which], parts = parts, parts + 1
    return Lists(dims, centroids, place, base, files, probes, margin)


def _route(lists: Lists):
    """A function over batches of (id, vec, asks, answers): a row for each part, or split list, that the vector travels to; a split list i is part -i - 1."""
    split = lists.base >= 0
    place = np.where(split, -np.arange(len(lists.base)) - 1, lists.part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                v = matrix(batch.column("vec"), lists.dims)
                ok = np.flatnonzero(usable(v))
                v = v[ok]
                if not len(ok):
                    continue
                ids = batch.column("id").take(pa.array(ok))
                asks, answers = [batch.column(c).to_numpy(zero_copy_only=False)[ok] for c in ("asks", "answers")]
                near, sims = _nearest_lists(unit(v), lists.centroids, max(lists.probes, OWN_PROBES))
                home = near[:, 0]
                close = (sims >= sims[:, :1] - lists.margin) & (np.arange(near.shape[1]) < lists.probes)
                probed = (close | ((place[near] == place[home][:, None]) & ~split[near])) & asks[:, None]
                yield _copies(np.arange(len(v)), near, probed, place[near], home, place[home], answers, ids, packed(v))

    return run


def _nearest_lists(v: np.ndarray, centroids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    sims = v @ centroids.T
    p = min(most, sims.shape[1])
    near = np.argpartition(-sims, p - 1, axis=1)[:, :p] if p < sims.shape[1] else np.tile(np.arange(p), (len(v), 1))
    order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    return near, np.take_along_axis(sims, near, 1)


def _copies(rows: np.ndarray, near: np.ndarray, probed: np.ndarray, parts: np.ndarray, home: np.ndarray, home_part: np.ndarray, answers: np.ndarray, ids: pa.Array, vec: pa.Array) -> pa.RecordBatch:
    """One row a vector and part: where it answers (home list, else -1), and the lists it probes there."""
    r, c = np.nonzero(probed)
    mine = np.flatnonzero(answers)
    who = np.concatenate([r, mine])
    where = np.concatenate([parts[r, c], home_part[mine]])
    probe = np.concatenate([near[r, c], np.full(len(mine), -1)])
    order = np.lexsort((np.concatenate([c, np.full(len(mine), -1)]), where, who))  # probed lists from the nearest on
    who, where, probe = who[order], where[order], probe[order]
    start = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (where[1:] != where[:-1]))) if len(who) else np.empty(0, int)
    asked = probe >= 0
    offsets = np.append(np.concatenate([[0], np.cumsum(asked)])[start], asked.sum()).astype(np.int32)
    w, p = who[start], where[start]
    at_home = answers[w] & (p == home_part[w])
    take = pa.array(rows[w])
    return pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(np.where(at_home, home[w], -1).astype(np.int32)), ids.take(take), vec.take(take), pa.ListArray.from_arrays(pa.array(offsets), pa.array(probe[asked].astype(np.int32)))], ["part", "home", "id", "vec", "probes"])


def _route_split(lists: Lists):
    """A function over rows of split lists, sorted by list: rows for the parts of their finer lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, c, starts, chunks = None, None, None, None
        for whole in batches:
            part = whole.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                which = -int(part[a]) - 1
                if which != held:
                    table = pa.concat_tables([pa.Table.from_batches([x]) for x in read_files(lists.files[which], ["chunks", "vec"])])
                    c = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float32).reshape(-1, lists.dims)
                    chunks = table.column("chunks").to_numpy()
                    held, starts = which, lists.base[which] + np.cumsum(chunks) - chunks
                for at in range(a, b, 2000):
                    batch = whole.slice(at, min(2000, b - at))
                    v = unit(wide(batch.column("vec"), lists.dims))
                    answers = batch.column("home").to_numpy() >= 0
                    asks = np.diff(batch.column("probes").offsets.to_numpy()) > 0
                    near, sims = _nearest_lists(v, c, lists.probes)
                    probed = (sims >= sims[:, :1] - lists.margin) & asks[:, None]
                    most = int(chunks[near].max())
                    names = starts[near]  # a finer list is called by its first part
                    h = _spread(batch.column("id")) if most > 1 else np.zeros(len(v), np.int64)
                    home_part = starts[near[:, 0]] + h % chunks[near[:, 0]]
                    for extra in range(most):  # usually one round: a chunked list is asked in all its chunks
                        there = probed & (chunks[near] > extra)
                        yield _copies(np.arange(len(v)), LISTS + names, there, names + extra, LISTS + names[:, 0], home_part, answers & (home_part == names[:, 0] + extra), batch.column("id"), batch.column("vec"))

    return run


def _spread(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) for x in ids.to_pylist()], np.int64)


def routed(rows: DataFrame, lists: Lists) -> DataFrame:
    """(part, home, id, vec, probes) of rows (id, vec, asks, answers)."""
    first = rows.select("id", "vec", "asks", "answers").mapInArrow(_route(lists), ROUTED)
    if not lists.files:
        return first
    finer = first.filter("part < 0").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).repartition("part", "salt").sortWithinPartitions("part").drop("salt")
    return first.filter("part >= 0").unionByName(finer.mapInArrow(_route_split(lists), ROUTED))


def part_rows(table: pa.Table, everywhere: bool = True) -> tuple[pa.Table, np.ndarray, dict[int, slice], np.ndarray, np.ndarray]:
    """The rows of a part by (home, id), each once; their homes; the rows of each list; (list, row) of what asks where, by list.

    everywhere: rows that only ask here answer, too, in the nearest list that they probe here."""
    table = table.combine_chunks()
    if everywhere:
        home, probes = table.column("home").to_numpy(), table.column("probes").combine_chunks()
        offsets = probes.offsets.to_numpy()
        first = np.append(probes.values.to_numpy(), -1)[offsets[:-1]]
        home = np.where((home < 0) & (np.diff(offsets) > 0), first, home).astype(np.int32)
        table = table.set_column(table.schema.get_field_index("home"), "home", pa.array(home))
    table = table.sort_by([("home", "ascending"), ("id", "ascending")])
    home, ids = table.column("home").to_numpy(), table.column("id")
    again = np.append(False, (home[1:] == home[:-1]) & pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy())
    if again.any():
        table = table.filter(pa.array(~again)).combine_chunks()
        home = home[~again]
    lists, counts = np.unique(home[home >= 0], return_counts=True)
    begin = np.append(0, np.cumsum(counts))[:-1] + (home < 0).sum()
    where = {int(x): slice(int(b), int(b + n)) for x, b, n in zip(lists, begin, counts, strict=True)}
    probes = table.column("probes").combine_chunks()
    probed, row = probes.flatten().to_numpy(), np.repeat(np.arange(len(home)), np.diff(probes.offsets.to_numpy()))
    order = np.argsort(probed, kind="stable")
    return table, home, where, probed[order], row[order]


def search_part(dims: int, k: int = 0, least: float | None = None, everywhere: bool = True):
    """A function over one part: (id, neighbour, similarity) of the k most similar answers of each row that asks, or of all from `least` on. Similarities are rounded to 9 decimals, ties go by name. everywhere: as in part_rows."""

    def run(table: pa.Table) -> pa.Table:
        table, _, where, probed, row = part_rows(table, everywhere)
        ids = table.column("id").combine_chunks()
        v = unit(wide(table.column("vec"), dims), np.float64)
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        found = []
        for x in np.unique(probed):
            data = where.get(int(x))
            if data is None:
                continue
            asking = row[np.searchsorted(probed, x) : np.searchsorted(probed, x, "right")]
            for at in range(0, len(asking), 1024):
                q = asking[at : at + 1024]
                s = np.round(v[q] @ v[data].T, 9)
                s[q[:, None] == np.arange(data.start, data.stop)] = -np.inf
                m = s.shape[1]
                line = least if least is not None else np.partition(s, m - k, axis=1)[:, [m - k]] if m > k else -2.0
                i, j = np.nonzero(s >= line) if least is not None else np.nonzero((s >= line) & (s > -2))
                found.append((q[i], data.start + j, s[i, j]))
        q, x, s = [np.concatenate(y) for y in zip(*found, strict=True)] if found else [np.empty(0, t) for t in (int, int, float)]
        if least is None and len(q):
            order = np.lexsort((rank[x], -s, q))
            q, x, s = q[order], x[order], s[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, x, s = q[keep], x[keep], s[keep]
        return pa.table({"id": ids.take(pa.array(q)), "neighbour": ids.take(pa.array(x)), "similarity": s})

    return run


PAIRS = "id string, neighbour string, similarity double"


def top_k(rows: DataFrame, k: int, ties: float = 0.0) -> DataFrame:
    """The k best rows of each id (equal ones by neighbour), and with ties > 0 also all within `ties` of the k-th."""
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    ranked = rows.withColumn("_rank", F.row_number().over(best))
    if ties > 0:
        kth = F.min(F.when(F.col("_rank") <= k, F.col("similarity"))).over(Window.partitionBy("id"))
        return ranked.withColumn("_kth", kth).filter(F.col("similarity") >= F.col("_kth") - ties).drop("_rank", "_kth")
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


@dataclass(frozen=True)
class Distinct:
    """rows: one (id, vec) for each vector that occurs, named by the least id. members: (rep, member) of those that occur several times, None if none does. n: different vectors."""

    rows: DataFrame
    members: DataFrame | None
    n: int


def distinct_vectors(rows: DataFrame) -> Distinct:
    """Equal vectors of rows (id, vec) brought together, so that a group of copies of any size is one row of a search."""
    hashes = [F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit(1)).alias("h2")]
    hashed = rows.select("id", *hashes)
    copies = materialize(hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    n, many = copies.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") > 1, 1))).first()
    if not many:
        return Distinct(rows, None, n)
    copies = copies.filter("n > 1").select("h1", "h2", "rep")
    reps = lookup_join(rows.select("id", "vec", *hashes), copies, ["h1", "h2"], "left", many).filter("rep is null or id = rep").select("id", "vec")
    members = lookup_join(hashed.distinct(), copies, ["h1", "h2"], "inner", many).select("rep", F.col("id").alias("member"))
    return Distinct(reps, materialize(members), n)


def usable_only(rows: DataFrame, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = np.flatnonzero(usable(matrix(batch.column("vec"), dims)))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ok))], ["id"])

    return rows.mapInArrow(run, "id string")


def among_all(rows: DataFrame, dims: int, k: int, ties: float, search: Callable, lists: int | None = None, part: int = PART, most: int = LISTS, probes: int = PROBES, margin: float = MARGIN) -> DataFrame:
    """(id, neighbour, similarity): the k most similar other rows of each, and those within `ties` of the k-th. search(dims, k, ties) gives the function over a part."""
    d = distinct_vectors(rows)
    empty = rows.sparkSession.createDataFrame([], PAIRS)
    tree = fit_lists(d.rows, d.n, dims, lists, part, most, probes, margin) if d.n else None
    if tree is None:
        return empty
    sent = routed(d.rows.select("id", "vec", F.lit(True).alias("asks"), F.lit(True).alias("answers")), tree)
    met = sent.groupBy("part").applyInArrow(search(dims, k, ties), PAIRS).repartition("id")  # two vectors may meet in several parts
    found = top_k(met.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity")), k, ties)
    if d.members is None:
        return found
    near = d.members
    if not ties:  # of equal neighbours, no more than k + 1 can be asked for
        near = near.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("member"))).filter(F.col("_r") <= k + 1).drop("_r")
        across = found.join(near.select(F.col("rep").alias("neighbour"), F.col("member").alias("nm")), "neighbour", "left")
    else:
        across = expand(found, near.select(F.col("rep").alias("neighbour"), F.col("member").alias("nm")), "neighbour", "nm")
    across = expand(across, d.members.select(F.col("rep").alias("id"), F.col("member").alias("qm")), "id", "qm")
    across = across.select(F.coalesce("qm", "id").alias("id"), F.coalesce("nm", "neighbour").alias("neighbour"), "similarity")
    good = usable_only(d.rows, dims).select(F.col("id").alias("rep"))
    if ties:
        pairs = pairs_within(d.members.join(good, "rep", "left_semi"), "rep", "member")
        within = pairs.select(F.col("a").alias("id"), F.col("b").alias("neighbour")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("neighbour")))
    else:
        both = d.members.join(good, "rep", "left_semi").join(near.select("rep", F.col("member").alias("nm")), "rep").filter("member != nm")
        within = both.select(F.col("member").alias("id"), F.col("nm").alias("neighbour"))
    return top_k(across.unionByName(within.withColumn("similarity", F.lit(1.0))), k, ties)


def similar_among(rows: DataFrame, dims: int, least: float, lists: int | None = None, part: int = PART, most: int = LISTS, probes: int = PROBES, margin: float = MARGIN) -> DataFrame:
    """(a, b, similarity), a < b: the pairs of rows (id, vec) with a cosine of at least `least` that meet in a list."""
    d = distinct_vectors(rows)
    tree = fit_lists(d.rows, d.n, dims, lists, part, most, probes, margin) if d.n else None
    if tree is None:
        return rows.sparkSession.createDataFrame([], "a string, b string, similarity double")
    sent = routed(d.rows.select("id", "vec", F.lit(True).alias("asks"), F.lit(True).alias("answers")), tree)
    found = sent.groupBy("part").applyInArrow(search_part(dims, least=least), PAIRS)
    found = found.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), "similarity").dropDuplicates(["a", "b"])
    if d.members is None:
        return found
    across = expand(found, d.members.select(F.col("rep").alias("a"), F.col("member").alias("ma")), "a", "ma")
    across = expand(across, d.members.select(F.col("rep").alias("b"), F.col("member").alias("mb")), "b", "mb")
    x, y = F.coalesce("ma", "a"), F.coalesce("mb", "b")
    across = across.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "similarity")
    good = usable_only(d.rows, dims).select(F.col("id").alias("rep"))
    within = pairs_within(d.members.join(good, "rep", "left_semi"), "rep", "member").select("a", "b", F.lit(1.0).alias("similarity"))
    return across.unionByName(within.filter(F.lit(least <= 1.0)))


def among_queries(rows: DataFrame, queries: DataFrame, dims: int, k: int, lists: int | None = None, part: int = PART, most: int = LISTS, probes: int = PROBES, margin: float = QUERY_MARGIN) -> DataFrame:
    """(id, neighbour, similarity): for each query (id, vec) the k most similar rows (id, vec). Both sides are partitioned by list."""
    tree = fit_lists(rows, rows.count(), dims, lists, part, most, probes, margin)
    if tree is None:
        return rows.sparkSession.createDataFrame([], PAIRS)
    flags = lambda asks, mark: [F.concat(F.lit(mark), "id").alias("id"), "vec", F.lit(asks).alias("asks"), F.lit(not asks).alias("answers")]
    sent = routed(rows.select(*flags(False, "n")).unionByName(queries.select(*flags(True, "q"))), tree)
    found = top_k(sent.groupBy("part").applyInArrow(search_part(dims, k, everywhere=False), PAIRS), k)
    return found.select(F.expr("substring(id, 2)").alias("id"), F.expr("substring(neighbour, 2)").alias("neighbour"), "similarity")
