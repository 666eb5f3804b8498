import random
import re

import numpy as np
import pytest

from loam.llm import leakage
from loam.llm.leakage import Index, build_index, leak_report, leaked_items, leaks, leaks_by_field, passages, pieces, walk
from loam.llm.words import WordHashes, hash_words

WORD = re.compile(r"[^\W_]+")


def brute(docs, items, run=14):
    grams = {}
    for i, *fields in items:
        for t in fields:
            w = WORD.findall((t or "").lower())
            for j in range(len(w) - run + 1):
                grams.setdefault(tuple(w[j : j + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for j in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[j : j + run]), ())}
    return out


def make(seed, n_items=40, n_docs=300, vocabulary=60):
    rng = random.Random(seed)
    words = [f"wort{i}" for i in range(vocabulary)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(5, 30)), text(rng.randrange(20, 60))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        t = text(rng.randrange(0, 90))
        if rng.random() < 0.5:
            src = rng.choice(items)[rng.randrange(1, 3)].split()
            at, k = rng.randrange(len(src)), rng.choice([5, 13, 14, 15, 40])
            t += " " + ", ".join(src[at : at + k]).upper() + "; " + text(rng.randrange(0, 40))
        docs.append((d, t))
    return docs, items


def test_same_as_brute_force_with_a_small_vocabulary(spark):
    for seed in range(3):
        docs, items = make(seed)
        docs += [(900, None), (901, ""), (902, " ".join([docs[0][1]] * 3000) + " " + items[3][2]), (903, items[5][2]), (903, items[5][2])]
        items += [(77, None, None), (78, "", "too short")]
        df = spark.createDataFrame([(*d, 1) for d in docs] + [(None, items[0][2], 1)], "doc_id long, text string, item_id int")
        it = spark.createDataFrame([(*i, 2) for i in items], "item_id long, prompt string, passage string, doc_id int")
        got = [tuple(r) for r in leaked_items(df, it).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, items)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    it = spark.createDataFrame([], "item_id long, prompt string, passage string")
    assert leaked_items(df, it).count() == 0
    assert leaked_items(df, spark.createDataFrame([(1, "a " * 20, None)], it.schema)).count() == 0


def test_search_loses_no_passage_with_a_run():
    docs, items = make(9, n_items=60)
    index = build_index([(i, t) for i, *t in items], 14)
    hashes = WordHashes()
    for e, item in enumerate(index.item[:20]):
        for f, text in enumerate(items[item][1:]):
            w = WORD.findall(text)
            for at in range(0, len(w) - 13, 5):
                h, _, _ = pieces(*hash_words([" ".join(w[at : at + 14])], hashes), 14)
                terms = np.unique(np.searchsorted(index.terms, h))[None]
                found = walk(index, terms)[1]
                assert (item, f) in set(zip(index.item[found].tolist(), index.field[found].tolist()))
    assert len(leaks(index, passages(*hash_words([items[0][2]], hashes), 14)))


@pytest.mark.parametrize("block", [1, 3, 8])
def test_walk_finds_what_exhaustive_scoring_finds(monkeypatch, block):
    """And it skips: with distinct words, few blocks are opened."""
    monkeypatch.setattr(leakage, "BLOCK", block)
    for vocabulary in (40, 3000):
        _, items = make(4, n_items=120, vocabulary=vocabulary)
        index = build_index([(i, t) for i, *t in items], 14)
        n, full = len(index.item), np.zeros((len(index.terms) + 1, len(index.item)))
        full[index.postings // n, index.postings % n] = index.impacts
        rng = np.random.default_rng(3)
        terms = np.sort(rng.integers(-1, len(index.terms), (400, 28)), 1)
        for q in range(0, 400, 2):  # half of the queries hold much of an entry
            mine = np.flatnonzero(full[:-1, rng.integers(n)])
            terms[q, : min(28, len(mine))] = mine[:28]
        terms.sort(1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = -1
        want = set(zip(*map(np.ndarray.tolist, np.nonzero(full[terms].sum(1) >= 1)), strict=True))
        counted = np.zeros(3, np.int64)
        got = walk(index, terms, counted)
        assert len(got[0]) == len(want) and set(zip(*map(np.ndarray.tolist, got), strict=True)) == want
        assert vocabulary == 40 or 0 < counted[2] < 0.1 * 400 * index.n_blocks


def test_index_goes_through_bytes():
    _, items = make(2)
    index = build_index([(i, t) for i, *t in items], 14)
    again = Index.load(index.dump())
    assert (again.postings == index.postings).all() and (again.impacts == index.impacts).all() and again.n_blocks == index.n_blocks


def test_items_of_several_parts_and_little_memory(spark, monkeypatch):
    """Parts of a few items, read again and again for a little text each: the same rows, and no limit of items."""
    monkeypatch.setattr(leakage, "ITEMS", 7)
    monkeypatch.setattr(leakage, "KEPT", 20_000)
    monkeypatch.setattr(leakage.searcher, "__defaults__", (5_000,))
    docs, items = make(6, n_items=90, n_docs=400)
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, prompt string, passage string")
    assert {tuple(r) for r in leaked_items(df, it).collect()} == brute(docs, items)


def test_prompt_and_passage_are_told_apart(spark):
    q, a = [" ".join(f"{x}{i}" for i in range(20)) for x in "qa"]
    it = spark.createDataFrame([(1, q, a), (2, None, a)], "item_id long, prompt string, passage string")
    df = spark.createDataFrame([(1, q + " " + a), (2, q), (3, a), (4, "x")], "doc_id long, text string")
    found = leaks_by_field(df, it)
    assert {tuple(r) for r in found.collect()} == {(1, 1, "prompt"), (1, 1, "passage"), (2, 1, "prompt"), (3, 1, "passage"), (1, 2, "passage"), (3, 2, "passage")}
    assert {tuple(r) for r in leak_report(found).collect()} == {(1, 3, 2, 2, 1), (2, 2, 0, 2, 0)}
