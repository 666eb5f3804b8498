from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from loam.operators.replica_diff import CELLS, SUMS, cell_positions, element_hash, peel, replica_diff

SCHEMA = "path string, updated_at timestamp_ntz, deleted_at timestamp_ntz, body string, k long, v int"
T = [datetime(2024, 1, d) for d in range(1, 10)]


def diff(spark, left, right):
    a, b = (spark.createDataFrame([(*r, 1, 2) for r in x], SCHEMA) for x in (left, right))
    out = replica_diff(a, b, "path", ["updated_at", "deleted_at", "body"], order="updated_at")
    return sorted((r["path"], r["diff"]) for r in out.collect()) if left or right else sorted(out.collect())


def test_hash_is_that_of_spark(spark):
    rows = [(1, 2), (-5, 1 << 62), (0, 0), (-(1 << 63), (1 << 63) - 1)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h"))
    assert all(element_hash(r.a, r.b) == r.h for r in df.collect())


def test_peel_reveals_both_sides_and_repeats():
    table = {}
    for key, row, n in [(7, 8, 1), (7, 9, -1), (-3, -4, -2), (5, 5, 3)]:
        h = element_hash(key, row)
        for p in cell_positions(h, CELLS):
            cell = table.setdefault(p, [0] * 6)
            for i, x in enumerate((1, key >> 32, key & 0xFFFFFFFF, row >> 32, row & 0xFFFFFFFF, h & 0x7FFFFFFF)):
                cell[i] += n * x
    found, whole = peel(pd.DataFrame([(k, *v) for k, v in table.items()], columns=["cell", *SUMS]), CELLS)
    assert whole and found == {(7, 8): 1, (7, 9): -1, (-3, -4): -2, (5, 5): 3}


def test_too_full_a_table_says_so():
    import random

    table = {}
    rng = random.Random(1)
    for _ in range(400):
        key, row = rng.getrandbits(62), rng.getrandbits(62)
        h = element_hash(key, row)
        for p in cell_positions(h, CELLS):
            cell = table.setdefault(p, [0] * 6)
            for i, x in enumerate((1, key >> 32, key & 0xFFFFFFFF, row >> 32, row & 0xFFFFFFFF, h & 0x7FFFFFFF)):
                cell[i] += x
    assert not peel(pd.DataFrame([(k, *v) for k, v in table.items()], columns=["cell", *SUMS]), CELLS)[1]


def test_kinds_of_difference(spark):
    left = [("/a", T[0], None, "x"), ("/b", T[0], None, "x"), ("/c", T[0], None, None), ("/d", T[1], T[2], ""), ("/e", T[0], None, "x")]
    right = [("/a", T[0], None, "x"), ("/c", T[0], None, ""), ("/d", T[3], None, ""), ("/f", T[0], None, "y"), ("/e", T[0], None, "X")]
    assert diff(spark, left, right) == [("/b", "only_local"), ("/c", "body"), ("/d", "deleted_at"), ("/d", "updated_at"), ("/e", "body"), ("/f", "only_remote")]


def test_older_state_and_repeated_rows_are_no_difference(spark):
    left = [("/a", T[2], None, "new")]
    right = [("/a", T[0], None, "old"), ("/a", T[2], None, "new"), ("/a", T[2], None, "new")]
    assert diff(spark, left, right) == []


def test_null_keys_are_one_key_and_empty_tables(spark):
    assert diff(spark, [(None, T[0], None, "a")], [(None, T[0], None, "b")]) == [(None, "body")]
    assert diff(spark, [], []) == []
    assert diff(spark, [("/a", None, None, None)], []) == [("/a", "only_local")]


def test_many_differences_are_exact(spark):
    left = [(f"/{i}", T[i % 3], None, "x" * (i % 50)) for i in range(3000)]
    right = [(f"/{i}", T[i % 3], None, "x" * (i % 50 if i % 2 else i % 7)) for i in range(200, 3300)]
    a, b = {r[0]: r for r in left}, {r[0]: r for r in right}
    want = [(k, "only_local") for k in a.keys() - b.keys()] + [(k, "only_remote") for k in b.keys() - a.keys()] + [(k, "body") for k in a.keys() & b.keys() if a[k][3] != b[k][3]]
    assert diff(spark, left, right) == sorted(want)


def test_key_and_fields_of_any_name(spark):
    a = spark.createDataFrame([("x", 1, "l"), ("y", 2, "l")], "key string, row int, side string")
    b = spark.createDataFrame([("x", 1, "r"), ("z", 2, "l")], "key string, row int, bucket string")
    assert sorted(map(tuple, replica_diff(a, b, "key", ["row"]).collect())) == [("y", "only_local"), ("z", "only_remote")]


def test_a_bucket_that_cannot_be_peeled_is_compared_directly(spark, monkeypatch):
    from loam.operators import replica_diff as module

    monkeypatch.setattr(module, "estimate_differences", lambda elements: 1)
    left = [(f"/{i}", T[0], None, "x") for i in range(900)]
    right = [(f"/{i}", T[0], None, "x" if i % 3 else "y") for i in range(900)]
    assert diff(spark, left, right) == sorted((f"/{i}", "body") for i in range(0, 900, 3))
