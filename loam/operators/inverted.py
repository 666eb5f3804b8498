"""Inverted lists of the terms that queries ask for, read block by block by the tasks that search them.

1. A node's text doesn't travel: where it is read, its terms become codes of a few bytes (`_codes`), and those are sorted by
   path. Nodes get numbers in that order, so that ties by path are ties by number, and are cut into blocks of at most
   `BLOCK`. A block's lists lie together in the shared folder.
2. Queries are dealt into chunks of about `CHUNK`. A task reads the blocks in turn, sums up the lists of one query at a time and
   holds its first k nodes. Pairs of a query and a node that meet in a term never travel: what comes out is at most k rows a query."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions import text as tx
from loam.session import BROADCAST_ROWS, lookup_join, materialize, read_files

#: Nodes of a block, and queries of a task.
BLOCK, CHUNK = 32768, 512

Lists = dict[int, tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Index:
    """names: (node, path, and the columns that were kept); asked: (no, query); terms: (no, code) of the queries' distinct terms; lists: (block, code, n, at, value), a block's node numbers first, under -1; nodes, queries: their numbers."""

    names: DataFrame
    asked: DataFrame
    terms: DataFrame
    lists: DataFrame
    nodes: int
    queries: int

    def doc_freqs(self) -> DataFrame:
        """(code, df) of the terms that any node has."""
        return self.lists.filter("code >= 0").groupBy("code").agg(F.sum("n").alias("df"))

    def search(self, rows: DataFrame, find: Callable, schema: str) -> DataFrame:
        """find(files), a function over the rows (no, code, ..) of a chunk of queries, applied to all chunks."""
        chunks = rows.repartition(max(1, math.ceil(self.queries / CHUNK)), "no")  # by number: rows are few bytes and much work
        return chunks.mapInArrow(_whole(find(sorted(self.lists.inputFiles()))), schema)

    def named(self, hits: DataFrame) -> DataFrame:
        """hits (no, node, ..) with the query, the path and the kept columns of the node. Hits travel once, by node and as numbers; up to BROADCAST_ROWS queries are sent to them."""
        return lookup_join(hits.join(self.names, "node"), self.asked, "no", rows=self.queries).drop("no", "node")


def _whole(run: Callable):
    """run, a function over a table, applied to all rows of a partition; nothing for none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches(max_chunksize=4096)

    return each


#: Terms that a task looks words up in at a time.
SLICE = BROADCAST_ROWS


def _codes(files: list[str], known: int, kept: list[str], titled: bool):
    """A function over batches of nodes (path, the kept columns, w, t, x): their terms as codes.

    `codes`: the sorted numbers of its words that any query asks for, a word as often as w has it; with titled, twice the
    number, and one more for a word of t. files: (term, code), read in slices, held if there is one."""
    kind = _kind(known)

    def slices() -> Iterator[tuple[pa.Array, np.ndarray]]:
        rows, n = [], 0
        for batch in read_files(files, ["term", "code"], SLICE):
            rows, n = [*rows, batch], n + batch.num_rows
            if n >= SLICE:
                yield _merged(rows)
                rows, n = [], 0
        if n:
            yield _merged(rows)

    def found(lists: pa.Array, held: list | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, code) of the elements of lists."""
        words, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        rows, codes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for terms, code in held or slices():
            at = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy()
            ok = np.flatnonzero(at >= 0)
            rows.append(row[ok])
            codes.append(code[at[ok]])
        return np.concatenate(rows), np.concatenate(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(slices()) if known <= SLICE else None
        for batch in batches:
            row, code = found(batch.column("w"), held)
            if titled:
                title_row, title_code = found(batch.column("t"), held)
                code = 2 * code + np.isin(row * known + code, title_row * known + title_code)
            order = np.lexsort((code, row))
            code, ends = code[order].astype(kind), np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            packed = pa.array([code[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", *kept, "x")), packed], ["path", *kept, "x", "codes"])

    return run


def _merged(rows: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
    table = pa.Table.from_batches(rows)
    return table.column("term").combine_chunks(), table.column("code").to_numpy()


def _kind(known: int) -> np.dtype:
    return np.dtype(np.min_scalar_type(2 * known + 1))


def _build(known: int, titled: bool, most: int):
    """A function over batches of nodes (node, x, codes): the lists of blocks of at most so many. Values are whether the title has the term, or without titled the number of times that a node has it, over x."""
    kind = _kind(known)

    def lists(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("node")  # files may come in another order
        node, x, codes = table.column("node").to_numpy(), table.column("x").to_numpy(), table.column("codes").to_pylist()
        code = np.frombuffer(b"".join(codes), kind)
        at = np.repeat(np.arange(len(node), dtype=np.int32), [len(c) // kind.itemsize for c in codes])
        value = (code & 1).astype(np.float64) if titled else None
        code = (code >> 1 if titled else code).astype(np.int64)
        order = np.argsort(code, kind="stable")
        code, at = code[order], at[order]
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (at[1:] != at[:-1]))) if len(code) else np.empty(0, np.int64)
        value = value[order][first] if titled else np.diff(np.append(first, len(code))) / x[at[first]]
        code, at = code[first], at[first]
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
        stop = np.append(start[1:], len(code))[: len(start)]
        ats = [node.tobytes(), *(at[a:b].tobytes() for a, b in zip(start, stop, strict=True))]
        values = [b"", *(value[a:b].tobytes() for a, b in zip(start, stop, strict=True))]
        block = pa.array(np.full(len(start) + 1, node[0]), pa.int64())
        return pa.RecordBatch.from_arrays([block, pa.array(np.append(-1, code[start])), pa.array(np.append(len(node), stop - start)), pa.array(ats, pa.binary()), pa.array(values, pa.binary())], ["block", "code", "n", "at", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == most:
                    yield lists(held)
                    held, n = [], 0
        if n:
            yield lists(held)

    return run


def build(nodes: DataFrame, queries: DataFrame, words: Column, norm: Column | None = None, titled: bool = False, keep: Sequence[str] = ()) -> Index:
    """The index of nodes (path, title, body, and columns to keep) for queries (query, text).

    words: of a node, kept as `w`, distinct with titled; a list's values: how often a node has the term, over norm (of `w`), or with titled whether its title has it."""
    asked = materialize(queries.select(F.col("query").cast("string").alias("query"), tx.lexemes(F.col("text")).alias("q")).withColumn("no", F.monotonically_increasing_id()))
    each = asked.select("no", F.explode("q").alias("term"))
    codes = materialize(_numbered(each.select("term").distinct()))
    known = codes.count()
    terms = lookup_join(each, codes, "term", rows=known).select("no", "code")
    kept = [c for c in keep if c != "path"]
    rows = nodes.select("path", *kept, words.alias("w"), *([tx.lexemes(F.col("title")).alias("t")] if titled else []))
    rows = rows.withColumn("x", F.lit(1.0) if norm is None else norm)
    schema = T.StructType([rows.schema[c] for c in ("path", *kept, "x")]).add("codes", "binary")
    docs = materialize(rows.mapInArrow(_codes(sorted(codes.inputFiles()), known, kept, titled), schema))
    docs = materialize(docs.orderBy("path").withColumn("node", F.monotonically_increasing_id()))
    lists = materialize(docs.select("node", "x", "codes").mapInArrow(_build(known, titled, BLOCK), "block long, code long, n long, at binary, value binary"))
    return Index(docs.select("node", "path", *kept), asked.select("no", "query"), materialize(terms), lists, docs.count(), asked.count())


def _numbered(terms: DataFrame) -> DataFrame:
    """(term, code): numbered from 0 on without gaps, as terms are written once."""
    terms = materialize(terms.withColumn("i", F.monotonically_increasing_id()).withColumn("part", F.shiftright("i", 33)))
    sizes = sorted((r["part"], r["n"]) for r in terms.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a task
    starts = {part: sum(n for p, n in sizes if p < part) for part, _ in sizes}
    start = F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv])[F.col("part")] if starts else F.lit(0)
    return terms.select("term", (start + F.col("i").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("code"))


def blocks(files: list[str], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, Lists]]:
    """The node numbers of each block and its lists of the wanted codes (sorted)."""
    held, ids, lists = None, np.empty(0, np.int64), {}
    for batch in read_files(files, ["block", "code", "at", "value"], 1024):
        code = batch.column("code").to_numpy()
        place = np.minimum(np.searchsorted(wanted, code), max(len(wanted) - 1, 0))
        for i in np.flatnonzero((code < 0) | (wanted[place] == code)):
            if code[i] < 0:
                if held is not None and lists:
                    yield ids, lists
                held, ids, lists = batch.column("block")[i].as_py(), np.frombuffer(batch.column("at")[i].as_py(), np.int64), {}
            else:
                lists[int(code[i])] = (np.frombuffer(batch.column("at")[i].as_py(), np.int32), np.frombuffer(batch.column("value")[i].as_py(), np.float64))
    if held is not None and lists:
        yield ids, lists


def _queries(no: np.ndarray) -> list[tuple[int, slice]]:
    """The rows of each query, where rows are sorted by query."""
    start = np.flatnonzero(np.append(True, no[1:] != no[:-1])) if len(no) else np.empty(0, int)
    return [(int(no[a]), slice(int(a), int(b))) for a, b in zip(start, np.append(start[1:], len(no)), strict=True)]


def _first(score: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest scores, equal ones by number."""
    if len(score) <= k:
        return np.arange(len(score))
    kth = np.partition(score, len(score) - k)[len(score) - k]
    near = np.flatnonzero(score >= kth)
    return near[np.lexsort((node[near], -score[near]))[:k]]


HITS = "no long, node long, score double"


def _in_all(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that lie in all lists (at, value), and the sum of their values."""
    at, score = (lists := sorted(lists, key=lambda x: len(x[0])))[0]
    for other, value in lists[1:]:
        i = np.searchsorted(other, at)
        ok = np.flatnonzero(other[np.minimum(i, len(other) - 1)] == at)
        at, score = at[ok], score[ok] + value[i[ok]]
    return at, score


def with_all(k: int | None):
    """Nodes with every term of a query by the sum of the values, rounded to 9 decimals: the first k, or all for None."""

    def find(files: list[str]):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("no")
            code, asks = table.column("code").to_numpy(), _queries(table.column("no").to_numpy())
            best: dict[int, tuple[np.ndarray, ...]] = {}
            for ids, lists in blocks(files, np.unique(code)):
                for no, rows in asks:
                    mine = [lists.get(int(c)) for c in code[rows]]
                    if any(x is None for x in mine):
                        continue
                    at, score = _in_all(mine)
                    found = ids[at], np.round(score, 9)
                    if no in best:
                        found = tuple(np.concatenate(x) for x in zip(best[no], found, strict=True))
                    if k is not None:
                        keep = _first(found[1], found[0], k)
                        found = found[0][keep], found[1][keep]
                    best[no] = found
            return _table(best, ["node", "score"], HITS)

        return run

    return find


COUNTS = "no long, n long"


def count_all():
    """The number of nodes with every term of a query, for queries that have any such node: a row a query, however many the nodes."""

    def find(files: list[str]):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("no")
            code, asks = table.column("code").to_numpy(), _queries(table.column("no").to_numpy())
            n: dict[int, int] = {}
            for _, lists in blocks(files, np.unique(code)):
                for no, rows in asks:
                    mine = [lists.get(int(c)) for c in code[rows]]
                    if all(x is not None for x in mine) and (met := len(_in_all(mine)[0])):
                        n[no] = n.get(no, 0) + met
            return pa.table([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["no", "n"])

        return run

    return find


def with_any(k: int, least_terms: int, least_mass: float):
    """Of the first k nodes by the sum of the weights of a query's terms that they have (rounded to 9 decimals), those with so many terms and such a sum.

    Their score is the least of 1, the sum / the query's mass (the sum of all its weights), and 1/2 + the sum of weights times values / that mass."""

    def find(files: list[str]):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("no")
            code, weight, asks = table.column("code").to_numpy(), table.column("w").to_numpy(), _queries(table.column("no").to_numpy())
            best: dict[int, tuple[np.ndarray, ...]] = {}
            for ids, lists in blocks(files, np.unique(code)):
                mass = np.zeros(len(ids))
                extra, count = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
                for no, rows in asks:
                    mine = [(lists[int(c)], w) for c, w in zip(code[rows], weight[rows], strict=True) if int(c) in lists]
                    if not mine:
                        continue
                    for (at, value), w in mine:
                        mass[at] += w
                        count[at] += 1
                        titled = np.flatnonzero(value)
                        extra[at[titled]] += w * value[titled]
                    held = best.get(no)
                    full = held is not None and len(held[0]) == k
                    at = np.flatnonzero(mass >= held[1].min() - 1e-8) if full and held[1].min() > 1e-6 else np.flatnonzero(count)
                    at = at[_first(np.round(mass[at], 9), at, k)]
                    found = ids[at], np.round(mass[at], 9), count[at], extra[at]
                    mass[:], extra[:], count[:] = 0, 0, 0
                    if held is not None:
                        found = tuple(np.concatenate(x) for x in zip(held, found, strict=True))
                        keep = _first(found[1], found[0], k)
                        found = tuple(x[keep] for x in found)
                    best[no] = found
            whole = {no: weight[rows].sum() or 1.0 for no, rows in asks}
            for no, (ids, matched, n, extra) in best.items():
                ok = np.flatnonzero((n >= least_terms) & (matched >= least_mass))
                best[no] = ids[ok], np.minimum(np.minimum(1.0, matched[ok] / whole[no]), 0.5 + extra[ok] / whole[no])
            return _table(best, ["node", "score"], HITS)

        return run

    return find


def _table(best: dict[int, tuple[np.ndarray, ...]], columns: list[str], schema: str) -> pa.Table:
    kinds = [pa.float64() if c.endswith("double") else pa.int64() for c in schema.split(", ")]
    no = np.repeat(np.array(list(best), np.int64), [len(f[0]) for f in best.values()])
    arrays = [no, *(np.concatenate(x) for x in zip(*best.values(), strict=True))] if best else [[] for _ in kinds]
    return pa.table([pa.array(x, t) for x, t in zip(arrays, kinds, strict=True)], names=["no", *columns])
