"""Orphan references: probe, changes, snapshots and the incremental state."""

import random
from datetime import datetime as D

from pyspark.sql import functions as F

from quillmark.operators import orphans as O

REFS = "ref_table string, ref_id long, key string, at timestamp_ntz"


def _refs(spark, rows):
    return spark.createDataFrame(rows, REFS)


def _parents(spark, rows):
    return O.presence(spark.createDataFrame(rows, "k string, added timestamp_ntz, gone timestamp_ntz, key string"), F.col("k"), "added", "gone")


def test_probe_borders_nulls_and_copies(spark):
    p = _parents(spark, [("a", D(2024, 1, 10), D(2024, 2, 1), "clash"), ("a", D(2024, 1, 10), D(2024, 2, 1), "clash"), ("n", None, None, None), (None, D(2024, 1, 1), None, None)])
    rows = [("t", 1, "a", D(2024, 1, 10)), ("t", 2, "a", D(2024, 2, 1)), ("t", 3, "a", D(2024, 1, 9)), ("t", 4, "z", D(2024, 1, 9)), ("t", 5, "a", None), ("t", 6, "z", None), ("t", 7, "n", D(2025, 1, 1))]
    got = {r["ref_id"] for r in O.probe(_refs(spark, rows), p).collect()}
    assert got == {2, 3, 4, 6, 7}


def test_references_drop_blank_keys(spark):
    df = spark.createDataFrame([(1, "x", D(2024, 1, 1)), (1, "x", D(2024, 1, 1)), (2, None, D(2024, 1, 1)), (3, "  ", D(2024, 1, 1))], "id long, key string, at timestamp_ntz")
    assert [r["ref_id"] for r in O.references(df, "t", "id", F.col("key"), "at").collect()] == [1]
    dot = spark.createDataFrame([(1, " . ", D(2024, 1, 1)), (2, " ", D(2024, 1, 1))], "id long, k string, at timestamp_ntz")
    assert [(r["ref_id"], r["key"]) for r in O.references(dot, "t", "id", F.regexp_replace(F.trim("k"), r"\.$", ""), "at", F.col("k")).collect()] == [(1, "")]


def test_overlapping_presence_is_merged(spark):
    p = _parents(spark, [("a", D(2024, 1, 1), D(2024, 3, 1), ""), ("a", D(2024, 2, 1), D(2024, 4, 1), ""), ("a", D(2024, 6, 1), None, "")])
    assert sorted((r["since"], r["until"]) for r in p.collect()) == [(D(2024, 1, 1), D(2024, 4, 1)), (D(2024, 6, 1), None)]


def _records(spark, rows):
    return O.parent_records(spark.createDataFrame(rows, "k string, added timestamp_ntz, gone timestamp_ntz, key string"), F.col("k"), "added", "gone")


def test_snapshots_follow_resolving_and_reopening(spark):
    p = _records(spark, [("a", D(2024, 2, 5), D(2024, 4, 5), "")])
    log = O.fold(_refs(spark, [("t", 1, "a", D(2024, 1, 3)), ("t", 2, "b", D(2024, 1, 4))]), p).log()
    got = {str(r["period"])[:7]: (r["orphaned"], r["resolved"], r["reopened"], r["pending"]) for r in O.pending_by_period(log).collect()}
    assert got == {"2024-01": (2, 0, 0, 2), "2024-02": (0, 1, 0, 1), "2024-04": (0, 0, 1, 2)}


def _moved(df):
    return sorted((r["ref_id"], r["change"], r["at"], r["sign"]) for r in df.collect())


def test_incremental_steps(spark, tmp_path):
    day = lambda n: D(2024, 1, n)
    arrive = lambda *rows: spark.createDataFrame(rows, "key string, since timestamp_ntz")
    leave = lambda *rows: spark.createDataFrame(rows, "key string, until timestamp_ntz")
    s = O.OrphanState(spark, str(tmp_path / "s"))
    s, moved = s.step(refs=_refs(spark, [("t", 1, "a", day(2)), ("t", 2, "b", day(2)), ("t", 9, None, day(2))]), arrivals=arrive(("b", day(1)), (None, day(1))))
    assert _moved(moved) == [(1, "orphaned", day(2), 1)]
    s, moved = s.step(arrivals=arrive(("a", day(5))), refs=_refs(spark, [("t", 2, "b", day(2))]))
    assert _moved(moved) == [(1, "resolved", day(5), 1)]
    s, moved = s.step(deletions=leave(("b", day(7))), refs=_refs(spark, [("t", 3, "b", day(8))]))
    assert _moved(moved) == [(2, "reopened", day(7), 1), (3, "orphaned", day(8), 1)]
    assert {r["ref_id"] for r in s.pending().collect()} == {2, 3}
    s, moved = s.step(arrivals=arrive(("b", day(9)), ("a", day(1))))  # b comes again; a was there all along
    assert _moved(moved) == [(1, "orphaned", day(2), -1), (1, "resolved", day(5), -1), (2, "resolved", day(9), 1), (3, "resolved", day(9), 1)]
    assert s.pending().count() == 0 and O.orphaned(s.log()).select("ref_id").collect()[0][0] == 3


def test_late_reference_of_an_old_time(spark, tmp_path):
    """A parent of 1 to 10 January, and a reference of the 5th that comes afterwards: live at its time, reopened on the 10th."""
    s = O.OrphanState(spark, str(tmp_path / "s"))
    s, _ = s.step(arrivals=spark.createDataFrame([("a", D(2024, 1, 1))], "key string, since timestamp_ntz"), deletions=spark.createDataFrame([("a", D(2024, 1, 10))], "key string, until timestamp_ntz"))
    s, moved = s.step(refs=_refs(spark, [("t", 1, "a", D(2024, 1, 5))]))
    assert _moved(moved) == [(1, "reopened", D(2024, 1, 10), 1)] and s.pending().count() == 1
    assert O.pending_by_period(s.log()).first()["pending"] == 1


def test_batches_in_any_order_agree_with_one_probe(spark, tmp_path):
    rnd = random.Random(8)
    day = lambda: D(2024, rnd.randint(1, 6), rnd.randint(1, 28))
    parents = [(rnd.choice("abcdef"), a, b if rnd.random() < 0.6 and b > a else None) for a, b in ((day(), day()) for _ in range(14))]
    refs = [("t", i, rnd.choice("abcdefgh"), day() if rnd.random() < 0.9 else None) for i in range(60)]
    p = _records(spark, [(*x, "") for x in parents])
    r = _refs(spark, refs)
    want = {x["ref_id"] for x in O.probe(r, _parents(spark, [(*x, "") for x in parents])).collect()}
    assert {x["ref_id"] for x in O.orphaned(O.fold(r, p).log()).collect()} == want and 5 < len(want) < 60
    snapshots = sorted(map(tuple, O.pending_by_period(O.fold(r, p, most=1).log()).collect()))
    assert sorted(map(tuple, O.pending_by_period(O.fold(r, p, most=5).log()).collect())) == snapshots
    for cut in range(2):  # rows cut into batches at random, deletions before arrivals too
        s, part = O.OrphanState(spark, str(tmp_path / str(cut))), lambda df, i, salt: df.where(F.pmod(F.xxhash64(F.lit(salt), *df.columns), F.lit(3)) == i)
        for i in range(3):
            s, _ = s.step(part(r, i, cut), part(p.select("key", "pid", "since"), i, cut + 5), part(p.where("until is not null").select("key", "pid", "until"), i, cut + 9))
        assert {x["ref_id"] for x in O.orphaned(s.log()).collect()} == want
        assert sorted(map(tuple, O.pending_by_period(s.log()).collect())) == snapshots


def test_empty_tables(spark):
    p = _parents(spark, [])
    assert O.probe(_refs(spark, []), p).count() == 0
    assert O.orphans_by_period(_refs(spark, [])).count() == 0
    assert O.fold(_refs(spark, []), _records(spark, [])).log().count() == 0
    assert O.fold(_refs(spark, [("t", 1, "a", None)]), _records(spark, [])).log().count() == 1
    assert O.probe(_refs(spark, [("t", 1, "a", D(2024, 1, 1))]), p).count() == 1
