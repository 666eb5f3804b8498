import os
import random

import pytest

from loam.llm import tokens as tk
from loam.llm.mixing import BINS, at_least, calibrate, copies, mix_sources
from loam.llm.splitting import oversized, split_documents, split_text

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(os.environ.get("LOAM_TOKENIZERS", tk.FOLDER), tk.VOCABULARY)), reason="no vocabulary file")


@pytest.fixture(scope="module")
def t():
    return tk.Tokenizer(tk.vocabulary())


def text(words, seed=0, paragraph=60):
    rng = random.Random(seed)
    out = []
    for i in range(words):
        w = "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 9)))
        out.append(w + (".\n\n" if i % paragraph == paragraph - 1 else ". " if i % 12 == 11 else ", " if i % 5 == 4 else " "))
    return "".join(out)


@pytest.mark.parametrize("limit, overlap", [(1000, 50), (100, 0), (60, 20), (7, 3)])
def test_pieces_cover_the_text_under_the_limit(t, limit, overlap):
    for x in (text(900), "a" * 4000, " " * 9000, "🙂" * 300, "x\r\n" * 800, text(300) + "b" * 3000 + text(300)):
        pieces = split_text(x, t, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(x)
        for a, b, n in pieces:
            assert a < b and (n == t.count(x[a:b]) <= limit)
        for (a0, b0, _), (a1, b1, _) in zip(pieces, pieces[1:], strict=False):
            assert a0 < a1 <= b0 < b1
            assert t.count(x[a1:b0]) <= overlap + 4 if overlap else a1 == b0


def test_overlap_is_the_one_asked_for_or_at_least_half_of_it(t):
    for x in (text(3000), text(2000, paragraph=7), "word " * 3000, "a" * 9000):
        pieces = split_text(x, t, 500, 60)
        assert len(pieces) > 4
        for (_, b0, _), (a1, _, _) in zip(pieces, pieces[1:], strict=False):
            assert 26 <= t.count(x[a1:b0]) <= 64


def test_cuts_prefer_paragraphs_and_pieces_are_balanced(t):
    x = text(2400, paragraph=40)
    pieces = split_text(x, t, 1000, 0)
    assert all(x[:b].endswith("\n\n") for _, b, _ in pieces[:-1])
    sizes = [n for *_, n in pieces]
    assert min(sizes) > 0.6 * max(sizes)
    assert split_text("short", t, 1000, 50) == [(0, 5, t.count("short"))]


def test_documents(spark, t):
    long = text(1500)
    rows = [(1, long, 5), (2, "short", 5), (3, None, 5), (4, "", 5), (None, long, 5), (1, long, 5)]
    out = split_documents(spark.createDataFrame(rows, "doc_id long, text string, piece_no int"))
    got = out.collect()
    assert [(r.doc_id, r.n_pieces, r.piece) for r in got if r.doc_id in (2, 3, 4)] == [(2, 1, "short"), (3, 1, None), (4, 1, "")]
    n = next(r.n_pieces for r in got if r.doc_id == 1)
    assert sum(r.doc_id == 1 for r in got) == 2 * n and all(r.piece == long[r.begin : r.end] for r in got if r.doc_id == 1)
    assert sorted((r.doc_id for r in oversized(out).collect()), key=str) == [1, None]
    assert split_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        split_documents(out.select("doc_id", "piece").toDF("doc_id", "text"), limit=5, overlap=5)


def test_shares_of_many_sources(spark):
    """More sources than a driver should hold slices of: each meets its share within its repeats."""
    n = 1200
    docs = spark.range(n * 12).selectExpr("id AS doc_id", f"concat('s', id % {n}) AS source", "repeat('word ', cast(5 + id % 7 AS int)) AS text")
    targets = spark.range(n).selectExpr("concat('S', id) AS source", f"1 / {n}d AS target_share", "4 AS max_repeats")
    report = mix_sources(docs, targets).report
    assert report.count() == n and report.filter("n_rows > 48 or n_rows = 0").count() == 0
    assert report.selectExpr("sum(actual_share) s").first().s == pytest.approx(1.0)


def test_poisson_inverse():
    p = at_least(0.7, 4)
    assert p == sorted(p, reverse=True) and abs(p[0] - (1 - 2.718281828 ** -0.7)) < 1e-6
    assert copies(0.0, p) == 4 and copies(0.999, p) == 0
    counts = [copies((i + 0.5) / 10000, at_least(1.3, 20)) for i in range(10000)]
    assert abs(sum(counts) / 10000 - 1.3) < 0.01
    slices = dict.fromkeys(range(BINS), 10)
    for want in (0, 1000, 40000, 90000):
        p = at_least(calibrate(slices, want, 3), 3)
        assert abs(sum(10 * copies((b + 0.5) / BINS, p) for b in slices) - want) <= 50
    assert calibrate(slices, 1e9, 3) == float("inf")


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, text(rng.randrange(5, 60), i), s) for i, s in enumerate(["Big-one"] * 600 + ["small"] * 60 + ["other"] * 30 + [None] * 3)] + [(9000, None, "small"), (9001, "", "small")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("big_one", 0.5, 1), ("SMALL", 0.4, 4), ("absent", 0.1, 2), (None, 0.1, 1), ("big one", None, None)], "source string, target_share double, max_repeats int")
    m = mix_sources(docs, targets)
    report = {r.source: r for r in m.report.collect()}
    assert abs(report["big_one"].actual_share - 0.5 / 0.9) < 0.02 and abs(report["small"].actual_share - 0.4 / 0.9) < 0.02
    assert report["absent"].n_rows == 0 and report["other"].target_share == 0 and report[None].n_docs == 3
    got = m.rows.collect()
    per = {}
    for r in got:
        per.setdefault(r.doc_id, []).append(r.copy_no)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in per.values())
    assert max(len(per[i]) for i in per if i < 600) <= 1 and max(len(x) for x in per.values()) <= 4 and 9000 not in per
    order = [r.mix_order for r in got]
    assert order == sorted(order) and [r.source for r in got] != sorted(r.source for r in got)
    assert {(r.doc_id, r.copy_no) for r in mix_sources(docs, targets).rows.collect()} == {(r.doc_id, r.copy_no) for r in got}
    capped = {r.source: r for r in mix_sources(docs, targets, total_tokens=10**9).report.collect()}
    assert capped["small"].n_rows == 4 * 60 and capped["big_one"].n_rows == 600
    empty = mix_sources(docs.limit(0), targets)
    assert empty.rows.count() == 0 and empty.report.count() == 3
    assert mix_sources(docs, targets.limit(0)).rows.count() == 0
