"""Evaluation texts in a corpus: an inverted index of the items with BM25 impacts, walked with block-max WAND by every passage.

1. Each field of each item (its prompt, its passage) is an entry. Terms are pieces of `GRAM` consecutive words, which are rarer than
   words, so lists are short and bounds tight; a run of `run` words is a run of run - GRAM + 1 terms. A term has a posting for each entry that contains it: the entry's
   number and the term's BM25 impact there. The threshold of an entry is the least score of any of its runs of `run` words, so a
   passage with such a run scores at least that: nothing is lost by the search, whatever the parameters. Impacts are divided by the
   threshold of their entry, so that 1 is the threshold of all.
2. Entries lie in blocks of `BLOCK`. A term's list of blocks holds the greatest impact in each, and the list's greatest one.
3. The corpus is cut into overlapping passages of `PASSAGE` words such that each run of `run` words lies within one. A passage is a
   query, and many are walked at once, each with a cursor in the block list of each of its terms. In a step, the cursors of a query
   are ordered by their block; the pivot is the first at which the sum of the lists' greatest impacts reaches 1: no entry before its
   block can. If the blocks' own maxima at the pivot's block reach 1, the block is opened, and its entries are scored by their
   postings; else it is skipped. All cursors before move on behind it. Queries without a pivot are done, most of them
   at once.
4. Retrieved entries are verified: some run of the passage has to be a run of the entry, of the prompt or of the passage.

Items are a table: they are dealt by hash into parts of about `ITEMS`, each indexed by a task of its own, and the indexes are written
to the shared folder. A worker reads one part after the other for a bounded amount of corpus text and keeps those that fit
into `KEPT` bytes. The corpus is read once, and nothing of it is shuffled before the result. The number of items isn't limited; the
work for a passage grows with its postings, and the parts read for each `TEXT` characters of it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.words import WORD, WordHashes, hash_words, mix, runs
from loam.session import materialize, read_files, worker_cache

K1, B = 1.2, 0.75
#: Entries of a block, items of a part of the index.
BLOCK, ITEMS = 8, 8192
#: Words of a term.
GRAM = 3
#: Words of a passage, passages that are walked at once, characters of text for which the parts are read in turn.
PASSAGE, CHUNK, TEXT = 28, 4096, 16_000_000
#: Bytes of indexes that a worker keeps.
KEPT = 256_000_000


@dataclass(frozen=True)
class Index:
    """One part of the items. Lists are sorted by (term, block) and (term, entry); term is the position in terms."""

    item: np.ndarray  #: of each entry
    field: np.ndarray  #: of each entry
    terms: np.ndarray  #: hashes, sorted
    most: np.ndarray  #: greatest impact of each term
    blocks: np.ndarray  #: term * n_blocks + block
    block_most: np.ndarray
    postings: np.ndarray  #: term * n_entries + entry
    impacts: np.ndarray
    keys: np.ndarray  #: of the entries' runs

    @property
    def n_blocks(self) -> int:
        return -(-len(self.item) // BLOCK)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Index:
        with np.load(io.BytesIO(data)) as x:
            return Index(**{f.name: x[f.name] for f in fields(Index)})


def _key(entry: np.ndarray, run: np.ndarray) -> np.ndarray:
    return mix(run ^ (entry.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def pieces(words: np.ndarray, counts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The terms of texts given by their words and numbers of words, the numbers of terms, and how many a run of words has."""
    n = min(GRAM, run)
    return runs(words, counts, n)[0], np.maximum(counts - n + 1, 0), run - n + 1


def build_index(items: Sequence[tuple[int, Sequence[str | None]]], run: int) -> Index | None:
    """items: (item, texts of its fields). Fields of fewer than `run` words can't leak; None if there is no other."""
    words, counts, run = pieces(*hash_words([t for _, texts in items for t in texts], WordHashes()), run)
    of = np.array([(i, f) for i, texts in items for f in range(len(texts))], np.int64).reshape(-1, 2)
    enough = counts >= run
    words, of, counts = words[np.repeat(enough, counts)], of[enough], counts[enough]
    if not len(of):
        return None
    n = len(of)
    terms, t = np.unique(words, return_inverse=True)
    e = np.repeat(np.arange(n), counts)
    order = _alike(e, t, n, len(terms))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    of, e, counts = of[order], place[e], counts[order]
    sort = np.lexsort((np.arange(len(e)), e))  # the words of each entry in order, entries in their new order
    e, t, words = e[sort], t[sort], words[sort]
    postings, tf = np.unique(t * n + e, return_counts=True)
    pt, pe = postings // n, postings % n
    df = np.bincount(pt, minlength=len(terms))
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    impacts = idf[pt] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * counts[pe] / counts.mean()))
    # the least score of a run: the impact of a word counts where it is first in the run
    each = impacts[np.searchsorted(postings, t * n + e)]
    s, at = [], np.arange(len(t))
    later = np.lexsort((at, t, e))
    again = np.append(False, (t[later][1:] == t[later][:-1]) & (e[later][1:] == e[later][:-1]))
    before = np.full(len(t), -1)
    before[later[again]] = later[:-1][again[1:]]
    ends = np.cumsum(counts)
    for i in range(run):
        first = at[: len(t) - run + 1] + i
        s.append(np.where(before[first] < at[: len(t) - run + 1], each[first], 0.0))
    whole = at[: len(t) - run + 1] + run <= ends[e[: len(t) - run + 1]]
    score = np.where(whole, np.sum(s, 0), np.inf)
    threshold = np.minimum.reduceat(score, np.minimum(ends - counts, len(score) - 1)) * (1 - 1e-9)
    impacts = impacts / threshold[pe]
    own, doc = runs(words, counts, run)
    n_blocks = -(-n // BLOCK)
    blocks, start = np.unique(pt * n_blocks + pe // BLOCK, return_index=True)
    begin = np.searchsorted(pt, np.arange(len(terms)))
    return Index(of[:, 0], of[:, 1], terms, np.maximum.reduceat(impacts, begin), blocks, np.maximum.reduceat(impacts, start), postings, impacts, np.unique(_key(doc, own)))


def _alike(e: np.ndarray, t: np.ndarray, n: int, n_terms: int) -> np.ndarray:
    """An order of the entries in which those that share their rarest words lie together, which makes the blocks' maxima tight."""
    pair = np.unique(e * n_terms + t)
    pe, pt = pair // n_terms, pair % n_terms
    df = np.bincount(pt, minlength=n_terms)
    rank = np.empty(n_terms, np.int64)
    rank[np.lexsort((np.arange(n_terms), df))] = np.arange(n_terms)
    shared = df[pt] > 1
    pe, pr = pe[shared], rank[pt[shared]]
    first = np.full((n, 3), n_terms, np.int64)
    order = np.lexsort((pr, pe))
    pe, pr = pe[order], pr[order]
    place = np.arange(len(pe)) - np.searchsorted(pe, pe)
    for k in range(3):
        first[pe[place == k], k] = pr[place == k]
    return np.lexsort((first[:, 2], first[:, 1], first[:, 0]))


def walk(index: Index, terms: np.ndarray, counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(passage, entry) of all scores of at least 1. terms: of each passage, each once, -1 where there is none.

    counted: adds up the numbers of (queries without any pivot, pivots, blocks opened)."""
    n, none = index.n_blocks, np.iinfo(np.int32).max
    bound = np.where(terms >= 0, index.most[terms], 0.0)
    live = np.flatnonzero(bound.sum(1) >= 1)
    if counted is not None:
        counted[0] += len(terms) - len(live)
    terms, bound = terms[live], bound[live]
    cursor = np.where(terms >= 0, np.searchsorted(index.blocks, np.maximum(terms, 0) * n), len(index.blocks))
    out = []

    def block_at(cursor: np.ndarray, terms: np.ndarray) -> np.ndarray:
        there = np.minimum(cursor, len(index.blocks) - 1)
        at = index.blocks[there]
        return np.where((terms >= 0) & (cursor < len(index.blocks)) & (at // n == terms), at % n, none)

    while len(live):
        block = block_at(cursor, terms)
        order = np.argsort(block, axis=1, kind="stable")
        sorted_block = np.take_along_axis(block, order, 1)
        reach = np.cumsum(np.where(sorted_block < none, np.take_along_axis(bound, order, 1), 0.0), 1) >= 1 - 1e-9
        some = reach.any(1)
        live, terms, bound, cursor, block = live[some], terms[some], bound[some], cursor[some], block[some]
        if not len(live):
            break
        pivot = np.take_along_axis(sorted_block[some], reach[some].argmax(1)[:, None], 1)
        # move the cursors before the pivot's block to it
        behind = block < pivot
        row, col = np.nonzero(behind)
        cursor[row, col] = np.searchsorted(index.blocks, terms[row, col] * n + pivot[row, 0])
        block[row, col] = block_at(cursor[row, col], terms[row, col])
        on = block == pivot
        most = np.where(on, index.block_most[np.minimum(cursor, len(index.blocks) - 1)], 0.0).sum(1)
        opened = np.flatnonzero(most >= 1 - 1e-9)
        if counted is not None:
            counted[1] += len(live)
            counted[2] += len(opened)
        if len(opened):
            r, c = np.nonzero(on[opened])
            out.append(_open(index, live[opened], terms[opened][r, c], r, pivot[opened, 0]))
        row, col = np.nonzero(on)
        cursor[row, col] += 1
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _open(index: Index, who: np.ndarray, terms: np.ndarray, row: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score the entries of one block for each of the queries `who`, by the postings of their terms (row: of which query each is)."""
    n = len(index.item)
    begin = terms * n + block[row] * BLOCK
    low = np.searchsorted(index.postings, begin)
    high = np.searchsorted(index.postings, np.minimum(begin + BLOCK, (terms + 1) * n))
    count = high - low
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    query = np.repeat(row, count)
    score = np.bincount(query * BLOCK + index.postings[at] % n - block[query] * BLOCK, index.impacts[at], len(who) * BLOCK).reshape(-1, BLOCK)
    q, e = np.nonzero(score >= 1 - 1e-9)
    return who[q], block[q] * BLOCK + e


@dataclass(frozen=True)
class Passages:
    """The terms of some texts as passages; run: terms of a run; doc: of each passage, at: its first term, length: of each."""

    words: np.ndarray
    run: int
    doc: np.ndarray
    at: np.ndarray
    length: np.ndarray
    width: int


def passages(words: np.ndarray, counts: np.ndarray, run: int) -> Passages:
    width = max(PASSAGE, run + 1) - min(GRAM, run) + 1
    words, counts, run = pieces(words, counts, run)
    step = width - run + 1
    ends = np.cumsum(counts)
    n = np.where(counts >= run, np.maximum(1, -(-(counts - run + 1) // step)), 0)
    doc = np.repeat(np.arange(len(counts)), n)
    at = (ends - counts)[doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    return Passages(words, run, doc, at, np.minimum(width, ends[doc] - at), width)


def leaks(index: Index, p: Passages, counted: np.ndarray | None = None) -> np.ndarray:
    """Rows (text, item, field) of the texts with a run of an entry, sorted, each once."""
    row = np.searchsorted(index.terms, p.words)
    row[row == len(index.terms)] = 0
    row = np.where(index.terms[row] == p.words, row, -1) if len(p.words) else row
    gain = np.where(row >= 0, index.most[row], 0.0)
    total = np.append(0.0, np.cumsum(gain))
    # the greatest impacts of a passage's words, repeated ones included, bound its score: most passages end here
    may = np.flatnonzero(total[p.at + p.length] - total[p.at] >= 1 - 1e-6)
    if counted is not None:
        counted[0] += len(p.doc) - len(may)
    found = []
    for c in range(0, len(may), CHUNK):
        part = may[c : c + CHUNK]
        at, length = p.at[part], p.length[part]
        grid = at[:, None] + np.arange(p.width)
        inside = np.arange(p.width) < length[:, None]
        terms = np.where(inside, row[np.where(inside, grid, 0)], -1)
        terms.sort(1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = -1  # each term once
        q, e = walk(index, terms, counted)
        if not len(q):
            continue
        steps = np.arange(p.width - p.run + 1)
        start = at[q][:, None] + steps
        ok = steps <= (length[q] - p.run)[:, None]
        h = _run_hashes(p.words, np.where(ok, start, at[q][:, None]), p.run)
        key = _key(np.broadcast_to(e[:, None], h.shape), h)
        hit = (ok & (index.keys[np.minimum(np.searchsorted(index.keys, key), len(index.keys) - 1)] == key)).any(1)
        found.append(np.stack([p.doc[part][q[hit]], index.item[e[hit]], index.field[e[hit]]], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)


def _run_hashes(words: np.ndarray, start: np.ndarray, run: int) -> np.ndarray:
    """As words.runs, of the runs that begin at `start`."""
    flat, back = np.unique(start, return_inverse=True)
    part = words[flat[:, None] + np.arange(run)]
    h, _ = runs(part.ravel(), np.full(len(flat), run), run)
    return h[back].reshape(start.shape)


def _indexer(run: int, fields_: int):
    """A function over the items of one part: its index, as bytes."""

    def build(table: pa.Table) -> pa.Table:
        texts = [table.column(f"f{i}").to_pylist() for i in range(fields_)]
        rows = sorted(zip(table.column("item").to_pylist(), *texts, strict=True), key=lambda r: (r[0], str(r[1:])))
        index = build_index([(r[0], r[1:]) for r in rows], run)
        blobs = [] if index is None else [index.dump()]
        return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(blobs), pa.int32()), "index": pa.array(blobs, pa.binary())})

    return build


def _indexes(files: Sequence[str]) -> Iterator[Index]:
    """The parts of the index, from memory where they fit."""
    cache = worker_cache().setdefault("leak indexes", {})
    if cache.get("files") != list(files):
        cache.clear()
        cache.update(files=list(files), held={}, size=0)
    for name in files:
        if name in cache["held"]:
            yield from cache["held"][name]
            continue
        blobs = [b for batch in read_files([name], ["index"], 1) for b in batch.column("index").to_pylist()]
        loaded = [Index.load(b) for b in blobs]
        size = sum(map(len, blobs))
        if cache["size"] + size <= KEPT:
            cache["held"][name] = loaded
            cache["size"] += size
        yield from loaded


def searcher(files: Sequence[str], run: int, most: int = TEXT):
    """A function over batches of (doc, text): (doc, item, field)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache().setdefault("words", WordHashes())
        docs: list[int] = []
        words: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def search() -> pa.RecordBatch:
            p = passages(np.concatenate(words), np.concatenate(counts), run)
            found = [leaks(index, p) for index in _indexes(files)]
            rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.array(docs, np.int64)[rows[:, 0]]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32))], ["doc", "item", "field"])

        for whole in batches:
            texts, ids = whole.column("text").to_pylist(), whole.column("doc").to_pylist()
            for at in range(0, len(texts), 500):
                part = texts[at : at + 500]
                w, c = hash_words(part, kept)
                words.append(w)
                counts.append(c)
                docs += ids[at : at + 500]
                size += sum(map(len, part))
                if size >= most:
                    yield search()
                    docs, words, counts, size = [], [], [], 0
        if docs:
            yield search()

    return scan


def leaks_by_field(corpus: DataFrame, items: DataFrame, doc_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", fields: Sequence[str] = ("prompt", "passage"), run: int = 14) -> DataFrame:
    """(doc, item, field): documents that share at least `run` consecutive words with a field of an item, each triple once.

    Null and empty texts and fields share nothing, nor do those of fewer than `run` words. Rows without an id are left
    out; repeated rows count once; other columns are ignored. Very long texts are searched whole."""
    rows = items.filter(F.col(f"`{item_column}`").isNotNull()).select(F.col(f"`{item_column}`").cast("long").alias("item"), *[F.col(f"`{c}`").cast("string").alias(f"f{i}") for i, c in enumerate(fields)]).distinct()
    rows = materialize(rows)
    parts = max(1, -(-rows.count() // ITEMS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")).repartition(parts, "part")
    table = materialize(dealt.groupBy("part").applyInArrow(_indexer(run, len(fields)), "part int, index binary"))
    docs = corpus.filter(F.col(f"`{doc_column}`").isNotNull() & F.col(f"`{text_column}`").isNotNull()).select(F.col(f"`{doc_column}`").cast("long").alias("doc"), F.col(f"`{text_column}`").cast("string").alias("text"))
    found = docs.mapInArrow(searcher(sorted(table.inputFiles()), run), "doc long, item long, field int").distinct()
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    return found.select("doc", "item", name.alias("field"))


def leaked_items(corpus: DataFrame, items: DataFrame, doc_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", fields: Sequence[str] = ("prompt", "passage"), run: int = 14) -> DataFrame:
    """(doc, item): as leaks_by_field, whatever the field."""
    return leaks_by_field(corpus, items, doc_column, text_column, item_column, fields, run).select("doc", "item").distinct()


def leak_report(found: DataFrame) -> DataFrame:
    """(item, n_docs, n_prompt, n_passage, n_both): documents by leaked item, and those with its prompt, its passage, or both. found: (doc, item, field)."""
    by_doc = found.groupBy("item", "doc").agg(F.max(F.col("field") == "prompt").alias("q"), F.max(F.col("field") == "passage").alias("a"))
    return by_doc.groupBy("item").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("q").alias("n_prompt"), F.count_if("a").alias("n_passage"), F.count_if(F.col("q") & F.col("a")).alias("n_both"))


__all__ = ["leaked_items", "leaks_by_field", "leak_report", "build_index", "leaks", "passages", "WORD"]
