"""Most similar vectors for every vector: an inverted file scanned with adaptive dimensions.

1. Vectors lie in lists of one or two levels (operators/vector_lists.py): the number of lists grows with the vectors, each travels
   to a bounded number of parts, and equal vectors are one row of the search.
2. In a part, vectors are rotated by a random orthogonal matrix, so that any leading block of columns is a random
   projection. The own list is compared whole, which gives each query its k-th distance so far. Every other probed list
   is scanned block by block; after d of D columns a candidate is abandoned if its partial distance rejects, at level
   EPSILON, the hypothesis that its whole distance is within the k-th one: partial > (d/D) (1 + EPSILON/sqrt(d))^2 tau^2.
3. What survives is compared again in double precision on the vectors as given, and the parts' results are merged.

Loss of accuracy: lists that aren't probed and candidates wrongly abandoned. `PROBES` and `EPSILON` set it; the tests hold
the recall against brute force.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.vector_lists import LISTS, MARGIN, PART, PROBES, SEED, among_all, part_rows, unit, wide
from loam.session import worker_cache

EPSILON = 2.1
BLOCK = 64
#: Slack of single precision.
SLACK = 1e-4
#: Entries of a tile, pairs that are compared at once, and the share of a tile above which it is scanned densely.
TILE, PAIRS, DENSE = 1 << 20, 1 << 16, 0.2


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    cache = worker_cache()
    if ("rotation", dims) not in cache:
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
        cache["rotation", dims] = (q * np.sign(np.diag(r))).astype(np.float32)
    return cache["rotation", dims]


class Scan:
    """Queries and data of one part."""

    def __init__(self, x: np.ndarray, k: int):
        self.x, self.k, dims = x, k, x.shape[1]
        self.ends = [*range(BLOCK, dims, BLOCK), dims]
        self.norms = np.stack([(x[:, :e] ** 2).sum(1) for e in self.ends])
        self.cut = np.array([(e / dims) * (1 + EPSILON / math.sqrt(e)) ** 2 if e < dims else 1.0 for e in self.ends], np.float32)
        self.best = np.full((len(x), k), -2, np.float32)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(self, q: np.ndarray, x: np.ndarray, s: np.ndarray) -> None:
        """Take compared pairs, unless a row with itself; tighten the queries' thresholds."""
        ok = (q != x) & (s >= self.best[q, 0] - SLACK)
        q, x, s = q[ok], x[ok], s[ok]
        if not len(q):
            return
        order = np.lexsort((-s, q))
        q, x, s = q[order], x[order], s[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        rows = q[first]
        new = np.full((len(rows), self.k), -2, np.float32)
        top = rank < self.k
        new[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(q))))[top], rank[top]] = s[top]
        self.best[rows] = np.sort(np.concatenate([self.best[rows], new], 1), axis=1)[:, -self.k :]
        ok = s >= self.best[q, 0] - SLACK
        self.found.append((q[ok], x[ok], s[ok]))

    def whole(self, q: np.ndarray, data: slice) -> None:
        """Compare queries with a list on all columns."""
        m = data.stop - data.start
        for at in range(0, len(q), max(1, TILE // m)):
            part = q[at : at + max(1, TILE // m)]
            s = self.x[part] @ self.x[data].T
            s[part[:, None] == np.arange(data.start, data.stop)] = -3
            least = np.partition(s, m - self.k, axis=1)[:, m - self.k] if m > self.k else np.full(len(part), -2.5, np.float32)
            i, j = np.nonzero(s >= np.maximum(least, self.best[part, 0])[:, None] - SLACK)
            self.keep(part[i], data.start + j, s[i, j])

    def adaptive(self, q: np.ndarray, data: slice) -> None:
        """Scan a list block by block, abandoning candidates."""
        m = data.stop - data.start
        for at in range(0, len(q), max(1, TILE // m)):
            self._tile(q[at : at + max(1, TILE // m)], data)

    def _tile(self, q: np.ndarray, data: slice) -> None:
        tau = 2 - 2 * (self.best[q, 0] - SLACK)
        dot, begin, last = np.zeros((len(q), data.stop - data.start), np.float32), 0, len(self.ends) - 1
        for b, end in enumerate(self.ends):
            dot += self.x[q, begin:end] @ self.x[data, begin:end].T
            d = self.norms[b, q][:, None] + self.norms[b, data][None] - 2 * dot
            alive = d <= (self.cut[b] * tau)[:, None]
            begin = end
            if b == last or alive.mean() < DENSE:
                break
        i, j = np.nonzero(alive)
        for at in range(0, len(i), PAIRS):
            qi, xj = q[i[at : at + PAIRS]], data.start + j[at : at + PAIRS]
            acc, limit, begin = d[i[at : at + PAIRS], j[at : at + PAIRS]], tau[i[at : at + PAIRS]], self.ends[b]
            for c in range(b + 1, last + 1):
                end = self.ends[c]
                gap = self.x[qi, begin:end] - self.x[xj, begin:end]
                acc = acc + np.einsum("ij,ij->i", gap, gap)
                ok = acc <= self.cut[c] * limit
                qi, xj, acc, limit, begin = qi[ok], xj[ok], acc[ok], limit[ok], end
            self.keep(qi, xj, 1 - acc / 2)


def search_part(dims: int, k: int, ties: float):
    """A function over one part: the k best of each query among the lists it probes here, and what lies within `ties` of the k-th."""

    def run(table: pa.Table) -> pa.Table:
        table, home, where, probed, row = part_rows(table)
        ids = table.column("id")
        raw = wide(table.column("vec"), dims)
        scan = Scan(unit(raw) @ rotation(dims), k)
        for data in where.values():
            scan.whole(np.arange(data.start, data.stop), data)
        other = probed != home[row]
        probed, row = probed[other], row[other]
        for x in np.unique(probed):
            if int(x) in where:
                scan.adaptive(row[np.searchsorted(probed, x) : np.searchsorted(probed, x, "right")], where[int(x)])
        q, x, s = [np.concatenate(y) for y in zip(*scan.found, strict=True)] if scan.found else [np.empty(0, t) for t in (int, int, np.float32)]
        ok = s >= scan.best[q, 0] - SLACK - ties
        q, x = q[ok], x[ok]
        exact_rows = unit(raw, np.float64)
        exact = np.concatenate([np.einsum("ij,ij->i", exact_rows[q[at : at + PAIRS]], exact_rows[x[at : at + PAIRS]]) for at in range(0, len(q), PAIRS)]) if len(q) else np.empty(0)
        order = np.lexsort((-exact, q))
        q, x, exact = q[order], x[order], exact[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, int)
        sizes = np.diff(np.append(first, len(q)))
        kth = np.repeat(exact[first + np.minimum(sizes, k) - 1], sizes) if len(q) else exact
        ok = exact >= kth - ties
        return pa.table({"id": ids.take(pa.array(q[ok])), "neighbour": ids.take(pa.array(x[ok])), "similarity": exact[ok]})

    return run


def knn(df: DataFrame, id_column: str, vector_column: str, dims: int, k: int = 5, ties: float = 0.0, probes: int = PROBES, margin: float = MARGIN, lists: int | None = None, part: int = PART, most: int = LISTS) -> DataFrame:
    """(id, neighbour, similarity): for every usable vector its k most similar other ones by cosine, and those within `ties` of the k-th.

    Usable is a vector of `dims` finite numbers that aren't all zero; others, and rows without an id, neither ask nor
    answer. Ids are unique; a row that comes twice counts once. Equal vectors are indexed once and share their neighbours.
    Fewer than k others: all of them. An empty table gives an empty result; other columns are ignored."""
    rows = df.filter(F.col(f"`{id_column}`").isNotNull() & (F.size(F.col(f"`{vector_column}`")) == dims))
    rows = rows.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col(f"`{vector_column}`").cast("array<float>").alias("vec"))
    return among_all(rows, dims, k, ties, search_part, lists, part, most, probes, margin)


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Unordered pairs of which either is among the other's neighbours."""
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
