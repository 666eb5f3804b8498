"""Nearest neighbours, similar pairs and ranks among all usable vectors, without a floor of similarity.

By default a search goes through the lists of vector_lists.py: the work grows with the number of vectors, not its square, and
what is lost is measured in tests and README. While there is one part (some thousands of vectors) nothing can be lost.
`exact=True` compares every two vectors: a task holds one block of rows and runs over all vectors in the shared folder.
Similarities are rounded to 9 decimals, ties go by path."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.vector import usable_vector
from loam.operators import vector_lists as vl
from loam.session import materialize, read_files, worker_cache

#: Rows of a block, and vectors that ranks beyond the nearest ones are estimated from.
ROWS, SAMPLE = 1024, 16384
#: Pairs of one row that a task ranks together.
CUT = 4096


def _rows(nodes: DataFrame, dims: int) -> DataFrame:
    """(id, vec) of usable vectors, named by path."""
    return nodes.filter(usable_vector(F.col("embedding"), dims)).select(F.col("path").alias("id"), F.col("embedding").cast("array<float>").alias("vec"))


def _block(path: str, blocks: int):
    return F.pmod(F.xxhash64(path), F.lit(blocks)).cast("int")


def _unit(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _batches(files: list[str], columns: list[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of all rows, each with the number of its first."""
    at = 0
    for batch in read_files(files, columns):
        yield at, batch
        at += len(batch)


def _lookup(values, among) -> np.ndarray:
    """Places of values in among, -1 where absent."""
    flat = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return np.asarray(pc.fill_null(pc.index_in(flat(values), value_set=flat(among)), -1), np.int64)


def _top(files: list[str], k: int):
    def run(table: pa.Table) -> pa.Table:
        paths, v = table.column("path"), _unit(table.column("v"))
        n = len(v)
        best, which = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        for base, batch in _batches(files, ["path", "v"]):
            s = np.round(v @ _unit(batch.column("v")).T, 9)
            own = _lookup(batch.column("path"), paths)
            s[own[own >= 0], np.nonzero(own >= 0)[0]] = -np.inf
            s = np.concatenate([best, s], 1)
            ids = np.concatenate([which, np.broadcast_to(np.arange(base, base + len(batch)), (n, len(batch)))], 1)
            row, col = np.nonzero(s >= np.partition(s, -k, axis=1)[:, [-k]])
            order = np.lexsort((col, -s[row, col], row))
            row, col = row[order], col[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col = row[keep], col[keep]
            best, which = s[row, col].reshape(n, k), ids[row, col].reshape(n, k)
        row, place = np.nonzero(best > -np.inf)
        chosen = which[row, place]
        wanted, back = np.unique(chosen, return_inverse=True)
        names = [batch.column("path").take(pa.array(wanted[(wanted >= base) & (wanted < base + len(batch))] - base)) for base, batch in _batches(files, ["path"])]
        b = pa.chunked_array(names, pa.string()).combine_chunks().take(pa.array(back))
        return pa.table({"a": paths.take(pa.array(row)), "b": b, "sim": best[row, place], "rank": place.astype(np.int64) + 1})

    return run


def nearest(nodes: DataFrame, k: int, dims: int, exact: bool = False) -> DataFrame:
    """(a, b, sim, rank): the k nodes most similar to each."""
    if exact:
        rows = materialize(nodes.filter(usable_vector(F.col("embedding"), dims)).select("path", F.col("embedding").alias("v")).orderBy("path"))
        rows, files = rows.withColumn("blk", _block("path", max(1, -(-rows.count() // ROWS)))), sorted(rows.inputFiles())
        return rows.groupBy("blk").applyInArrow(_top(files, k), "a string, b string, sim double, rank long").select("a", "b", "sim", "rank")
    found = vl.among_all(_rows(nodes, dims), dims, k, 0.0, lambda d, k, ties: vl.search_part(d, k))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")).cast("long")
    return found.select(F.col("id").alias("a"), F.col("neighbour").alias("b"), F.col("similarity").alias("sim"), rank.alias("rank"))


def _packed(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), vl.packed(vl.matrix(batch.column("vec"), dims))], ["path", "v"])

    return run


def packed_vectors(nodes: DataFrame, dims: int) -> DataFrame:
    """(path, v: bytes) of usable vectors, as a table in the shared folder, in half precision where that is exact."""
    return materialize(_rows(nodes, dims).mapInArrow(_packed(dims), "path string, v binary"))


def _products(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = [vl.unit(vl.wide(batch.column(c), dims), np.float64) for c in ("x", "y")]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.round(np.einsum("ij,ij->i", x, y), 9))], ["a", "b", "sim"])

    return run


def similarities(vectors: DataFrame, pairs: DataFrame, dims: int) -> DataFrame:
    """(a, b, sim) of given pairs; those with an end without vector are left out. vectors: of packed_vectors."""
    x, y = vectors.select(F.col("path").alias("a"), F.col("v").alias("x")), vectors.select(F.col("path").alias("b"), F.col("v").alias("y"))
    return pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_products(dims), "a string, b string, sim double")


def _sampled(files: list[str], dims: int) -> tuple[list[str], np.ndarray]:
    cache = worker_cache()
    if cache.get("rank sample", (None,))[0] != files:
        rows = pa.Table.from_batches(list(read_files(files, ["path", "v"]))).sort_by("path")
        cache["rank sample"] = files, rows.column("path").to_pylist(), vl.unit(vl.wide(rows.column("v"), dims), np.float64)
    return cache["rank sample"][1:]


def _ranks(files: list[str], dims: int, scale: float):
    fine, apart, away = 1e9, 4_000_000_000, -1_500_000_000

    def run(table: pa.Table, pairs: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "sim": pa.array([], pa.float64()), "rank": pa.array([], pa.int64())})
        if not table.num_rows or not pairs.num_rows:
            return none
        i = _lookup(pairs.column("a"), table.column("path"))
        order = np.argsort(i, kind="stable")
        order = order[np.searchsorted(i[order], 0) :]
        pairs, i = pairs.take(pa.array(order)), i[order]
        names, sample = _sampled(files, dims)
        v = vl.unit(vl.wide(table.column("v"), dims), np.float64)
        mine = np.rint(pairs.column("sim").to_numpy() * fine).astype(np.int64)
        own, other = _lookup(table.column("path"), pa.array(names, pa.string())), _lookup(pairs.column("b"), pa.array(names, pa.string()))
        b, above = pairs.column("b").to_pylist(), np.zeros(len(i), np.int64)
        for at in range(0, len(v), 256):
            s = np.rint(v[at : at + 256] @ sample.T * fine).astype(np.int64)
            here = own[at : at + 256]
            s[np.nonzero(here >= 0)[0], here[here >= 0]] = away
            part = slice(np.searchsorted(i, at), np.searchsorted(i, at + 256))
            row, m, o = i[part] - at, mine[part], other[part]
            line = (np.sort(s, 1) + np.arange(len(s))[:, None] * apart).ravel()
            low, high = np.searchsorted(line, m + row * apart, "left"), np.searchsorted(line, m + row * apart, "right")
            more, same = (row + 1) * s.shape[1] - high, high - low
            inside = np.nonzero(o >= 0)[0]  # its own entry, which may be off by rounding, counts neither above nor beside it
            there = s[row[inside], o[inside]]
            more[inside] -= there > m[inside]
            same[inside] -= there == m[inside]
            for x in np.nonzero(same > 0)[0]:
                more[x] += np.count_nonzero(s[row[x], : bisect_left(names, b[part.start + x])] == m[x])
            above[part] = more
        return pa.table({"a": pairs.column("a"), "b": pairs.column("b"), "sim": pairs.column("sim"), "rank": np.rint(above * scale).astype(np.int64) + 1})

    return run


def ranks(vectors: DataFrame, sims: DataFrame, dims: int) -> DataFrame:
    """(a, b, sim, rank) of given pairs (a, b, sim), both ways: the place of b among all neighbours of a.

    Counted among `SAMPLE` vectors, the first by hash, and scaled to all of them: exact up to that number of vectors, beyond it
    an estimate (its relative error is about the root of rank divided by n times SAMPLE, so nearest ones are better taken from `nearest`)."""
    n = vectors.count()
    sample = materialize(vectors.orderBy(F.xxhash64("path"), "path").limit(SAMPLE))
    both = materialize(sims.select("a", "b", "sim").unionByName(sims.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")))
    cuts = both.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CUT).cast("int").alias("cuts"))
    blocks = max(1, -(-n // ROWS))
    place = F.pmod(F.xxhash64("path", "cut"), F.lit(blocks)).cast("int")
    held = vectors.join(cuts.withColumnRenamed("a", "path"), "path").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("path", "v", place.alias("blk"))
    asked = both.join(cuts, "a").withColumn("path", F.col("a")).withColumn("cut", F.pmod(F.xxhash64("b"), F.col("cuts")).cast("int")).select("a", "b", "sim", place.alias("blk"))
    scale = max(1.0, n / SAMPLE)
    return held.groupBy("blk").cogroup(asked.groupBy("blk")).applyInArrow(_ranks(sorted(sample.inputFiles()), dims, scale), "a string, b string, sim double, rank long")


def pair_ranks(nodes: DataFrame, ranked: DataFrame, pairs: DataFrame, dims: int) -> DataFrame:
    """As ranks, of pairs (a, b), a < b, with the similarities and ranks taken from ranked (of `nearest`) where it has them."""
    vectors = packed_vectors(nodes, dims)
    known = ranked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").dropDuplicates(["a", "b"])
    both = pairs.select("a", "b").join(known, ["a", "b"], "left")
    sims = both.filter("sim is not null").unionByName(similarities(vectors, both.filter("sim is null"), dims))
    rows = ranks(vectors, sims, dims).join(ranked.select("a", "b", F.col("rank").alias("near")), ["a", "b"], "left")
    return rows.select("a", "b", "sim", F.coalesce("near", "rank").alias("rank"))


def similar_pairs(nodes: DataFrame, least: float, dims: int, exact: bool = False) -> DataFrame:
    """(path_a, path_b, sim): pairs with a cosine of at least `least`, path_a < path_b. Vectors that aren't usable have none."""
    if exact:
        from loam.operators.graph import similar_pairs as every_pair

        return every_pair(nodes, least, dims)
    found = vl.similar_among(_rows(nodes, dims), dims, least)
    return found.select(F.col("a").alias("path_a"), F.col("b").alias("path_b"), F.col("similarity").alias("sim"))
