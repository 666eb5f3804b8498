from datetime import datetime

import pytest

from loam.operators import references
from loam.operators.references import Reference, orphan_report, orphans
from loam.session import lookup_join

T = [datetime(2024, m, 1) for m in range(1, 10)]
REFS = "id string, a string, b string, created_at timestamp_ntz, updated_at timestamp_ntz, extra int"
TARGET = "x string, y string, id int, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz, extra int"


def run(spark, refs, target, ref):
    r = spark.createDataFrame([(*x, 1) for x in refs], REFS)
    t = spark.createDataFrame([(*x[:2], 9, *x[2:], 1) for x in target], TARGET)
    return sorted((x.ref_id, x.kind) for x in orphans(ref, r, t).collect())


ONE = Reference("r", ("a",), "t", ("x",), fold_case=True)


def test_kinds_and_case(spark):
    target = [("K1", None, T[0], T[0], None), ("k2", None, T[0], T[0], T[1]), ("k3", None, T[5], T[5], None)]
    refs = [("1", "k1", None, T[2], T[2]), ("2", "K2", None, T[2], T[2]), ("3", "k3", None, T[2], T[2]), ("4", "k4", None, T[2], T[2]), ("5", None, None, T[2], T[2]), ("6", "", None, T[2], T[2]), ("7", "k3", None, T[6], T[6]), ("8", "k3", None, None, None)]
    assert run(spark, refs, target, ONE) == [("2", "deleted"), ("3", "late"), ("4", "missing"), ("6", "missing")]


def test_repeated_rows_count_once_and_the_latest_state_holds(spark):
    target = [("k1", None, T[0], T[0], None), ("k1", None, T[0], T[3], T[3])]
    refs = [("1", "k1", None, T[2], T[2])] * 3 + [("2", "zz", None, T[2], T[2]), ("2", "k1", None, T[2], T[4])]
    assert run(spark, refs, target, ONE) == [("1", "deleted"), ("2", "deleted")]


def test_rows_without_id_and_empty_tables(spark):
    assert run(spark, [(None, "q", None, T[1], T[1]), (None, "p", None, T[1], T[1])], [], ONE) == [(None, "missing"), (None, "missing")]
    assert run(spark, [], [("k", None, T[0], T[0], None)], ONE) == []


@pytest.mark.parametrize("match, want", [("simple", [("4", "missing")]), ("partial", [("3", "missing"), ("4", "missing")]), ("full", [("2", "partial_null"), ("3", "partial_null"), ("4", "missing")])])
def test_composite_keys(spark, match, want):
    target = [("p", "q", T[0], T[0], None), ("p", "r", T[0], T[0], None)]
    refs = [("1", "p", "q", T[2], T[2]), ("2", "p", None, T[2], T[2]), ("3", None, "z", T[2], T[2]), ("4", "p", "z", T[2], T[2]), ("5", None, None, T[2], T[2])]
    assert run(spark, refs, target, Reference("r", ("a", "b"), "t", ("x", "y"), match)) == want


def test_unknown_match(spark):
    with pytest.raises(ValueError):
        run(spark, [], [], Reference("r", ("a",), "t", ("x",), "most"))


def test_salted_lookup_gives_the_same(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "i long, k string")
    small = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    for how in ("inner", "left"):
        a, b = (sorted(map(tuple, lookup_join(big, small, "k", how, limit=n).select("i", "k", "v").collect()), key=str) for n in (0, 100))
        assert a == b and len(a) == (201 if how == "inner" else 300)


def test_report(spark, monkeypatch):
    refs = spark.createDataFrame([("1", "z", None, T[0], T[0], 1), ("2", "z", None, T[0], T[0], 1), ("3", "z", None, None, None, 1)], REFS)
    target = spark.createDataFrame([], TARGET)
    rows = orphan_report(orphans(ONE, refs, target)).collect()
    assert sorted((str(r.period), r.kind, r.n) for r in rows) == [("2024-01-01", "missing", 2), ("None", "missing", 1)]
    assert references.MATCHES
