import random
import re
from collections import Counter

import numpy as np
import pytest

from loam.llm import neardup
from loam.llm.gray import forest, gray_code, gray_rank, join
from loam.llm.neardup import expand_pairs, groups, near_duplicates

WORD = re.compile(r"[^\W_]+")


def brute(rows, threshold, n, min_words=0):
    sets = {}
    for i, t, b in rows:
        w = WORD.findall(f"{t or ''} {b or ''}".lower())
        if i is not None and len(w) >= max(n, min_words):
            sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_gray_ranks_round_trip_and_neighbours_differ_in_one_bit():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    a, b = gray_code(*gray_rank(hi, lo))
    assert (a == hi).all() and (b == lo).all()
    h, l = gray_code(np.zeros(64, np.uint64), np.arange(64, dtype=np.uint64))  # noqa: E741
    assert (np.bitwise_count(h[1:] ^ h[:-1]) + np.bitwise_count(l[1:] ^ l[:-1]) == 1).all()


@pytest.mark.parametrize("n, radius", [(1, 5), (7, 60), (700, 20), (700, 48), (700, 128)])
def test_index_join_is_exact(n, radius):
    rng = np.random.default_rng(n + radius)
    base = rng.integers(0, 1 << 63, (2, 20), dtype=np.uint64)
    pick = rng.integers(0, 20, n)
    noise = rng.integers(0, 1 << 63, (4, n), dtype=np.uint64)
    hi, lo = base[0][pick] ^ (noise[0] & noise[1] & noise[2]), base[1][pick] ^ (noise[1] & noise[2] & noise[3])
    order = np.lexsort(gray_rank(hi, lo)[::-1])
    hi, lo = hi[order], lo[order]
    d = np.bitwise_count(hi[:, None] ^ hi) + np.bitwise_count(lo[:, None] ^ lo)
    want = {(i, j) for i, j in zip(*np.nonzero(d <= radius), strict=True) if i < j}
    assert set(zip(*map(np.ndarray.tolist, join((hi, lo), None, radius)), strict=True)) == want
    half = n // 2
    if half:
        i, j = join((hi[:half], lo[:half]), (hi[half:], lo[half:]), radius)
        assert set(zip(i.tolist(), (j + half).tolist(), strict=True)) == {p for p in want if p[0] < half <= p[1]}


def clusters(sizes, noise, seed=0):
    """Fingerprints of several trees in Gray order; the rows of a tree lie in clusters that differ in about 128 / 2^noise bits."""
    rng = np.random.default_rng(seed)
    his, los = [], []
    for n in sizes:
        base = rng.integers(0, 1 << 63, (2, max(1, n // 5)), dtype=np.uint64)
        pick, z = rng.integers(0, base.shape[1], n), rng.integers(0, 1 << 63, (2 * noise, n), dtype=np.uint64)
        hi, lo = base[0][pick] ^ np.bitwise_and.reduce(z[:noise]), base[1][pick] ^ np.bitwise_and.reduce(z[noise:])
        order = np.lexsort(gray_rank(hi, lo)[::-1])
        his.append(hi[order])
        los.append(lo[order])
    return np.repeat(np.arange(len(sizes)), sizes), np.concatenate(his), np.concatenate(los)


@pytest.mark.parametrize("noise", [3, 5])
@pytest.mark.parametrize("radius", [0, 20, 47, 128])
def test_forest_is_exact(radius, noise):
    tree, hi, lo = clusters([2, 3, 1, 9, 8, 64, 65, 700, 1, 2, 513], noise)
    d = np.bitwise_count(hi[:, None] ^ hi) + np.bitwise_count(lo[:, None] ^ lo)
    i, j = np.nonzero((d <= radius) & (tree[:, None] == tree))
    want = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b}
    i, j = forest(tree, hi, lo, radius)
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_forest_leaves_groups_before_it_looks_at_pairs():
    """With tight clusters, most pairs of groups are left by their accumulated differences, and few pairs of rows are compared."""
    tree, hi, lo = clusters([2000, 700], 5)
    seen = Counter()
    i, _ = forest(tree, hi, lo, 20, seen)
    every = 2000 * 1999 // 2 + 700 * 699 // 2
    assert seen["left"] > 0.9 * seen["groups"] > 0 and seen["pairs"] < every / 20 and seen["pairs"] >= len(i) > 1000


def test_every_pair_comes_out_of_the_index(spark, monkeypatch):
    rows = corpus()
    near_all = [tuple(r) for r in expand_pairs(near_duplicates(frame(spark, rows), "id", ["title", "body"], threshold=0.5, n=3)).collect()]
    monkeypatch.setattr(neardup, "forest", lambda tree, hi, lo, radius: (np.empty(0, np.int64), np.empty(0, np.int64)))
    found = near_duplicates(frame(spark, rows), "id", ["title", "body"], threshold=0.5, n=3)
    assert len(near_all) > 50 and found.pairs.count() == 0


def test_large_classes_and_many_links_are_met_in_blocks(spark, monkeypatch):
    from loam.operators import blocks

    monkeypatch.setattr(blocks.blocked, "__defaults__", (7,))
    monkeypatch.setattr(blocks.pairs_within, "__defaults__", (7,))
    monkeypatch.setattr(blocks.expand, "__defaults__", (7,))
    words = [f"w{i}" for i in range(60)]
    same = [(f"s{i:02}", " ".join(words), "") for i in range(40)]
    near = [(f"n{i:02}", " ".join(words + [f"x{i}", f"y{i}", f"z{i}"]), "") for i in range(20)]
    rows = same + near
    got = [tuple(r) for r in expand_pairs(near_duplicates(frame(spark, rows), "id", ["title", "body"], threshold=0.5, n=3)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.5, 3) and len(got) == 60 * 59 // 2


def corpus(seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        for v in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(v):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((f"{k:02}-{v}", "Title", " ".join(w)))
    rows += [("null", None, None), ("empty", "", ""), ("short", "a", "b"), ("long-1", "x", "so much text " * 20000), ("long-2", "x", "so much text " * 20000)]
    return rows


SCHEMA = "id string, title string, body string, num long, a int, bands int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("hot", [4096, 3])
def test_pairs_match_brute_force_whatever_the_block_size(spark, hot):
    rows = corpus() + [(f"copy-{i}", "Title", "one and the same long text that comes again and again in this place here") for i in range(12)]
    found = near_duplicates(frame(spark, rows), "id", ["title", "body"], threshold=0.5, n=3, hot=hot)
    got = [tuple(r) for r in expand_pairs(found).collect()]
    want = brute(rows, 0.5, 3)
    assert len(got) == len(set(got)) and not set(got) - want and len(set(got)) >= 0.99 * len(want)


def test_groups_repeated_rows_null_ids_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("a", text, None), ("a", text, None), ("b", None, text), ("c", text, "and more"), (None, text, None), ("d", "else", "entirely other words in this one here")]
    found = near_duplicates(frame(spark, rows), "id", ["title", "body"])
    got = {r.id: r for r in groups(found).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["a"].class_id == got["b"].class_id == "a"
    assert got["c"].group_id == "a" and got["c"].n_links == 1 and got["d"].group_id == "d" and got["d"].n_links == 0
    assert {tuple(r) for r in expand_pairs(found).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    nothing = near_duplicates(frame(spark, []), "id", ["title", "body"])
    assert expand_pairs(nothing).count() == 0 and groups(nothing).count() == 0
