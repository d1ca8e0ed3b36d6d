"""Judgements on small tables."""

import pytest
from pyspark.sql import functions as F

from quillmark.operators import judge as J


def test_verdicts(spark):
    rows = [("whole", list("abc"), list("abc")), ("one word changed", list("abcd"), list("abxd")), ("held inside", list("bc"), list("abcd")), ("same words, other order (2 roots)", list("ab"), list("ba")), ("departs", list("abcd"), list("wxyz")), ("formula", list("abcdef"), list("xyabcz")), ("departs", [], list("a"))]
    df = spark.createDataFrame(rows, "want string, ua array<string>, ub array<string>")
    for r in J.verdict(df).collect():
        assert r["verdict"] == r["want"]


def test_in_time(spark):
    rows = [(-700, -500, -540, None, "later"), (-700, -720, -540, None, "contemporary (disputed)"), (80, None, None, None, "?"), (80, 20, 85, 25, "earlier"), (80, 105, None, None, "contemporary")]
    df = spark.createDataFrame(rows, "a int, b int, ac int, bc int, want string")
    for r in df.select("want", J.in_time_disputed(F.col("a"), F.col("b"), F.col("ac"), F.col("bc")).alias("x")).collect():
        assert r["x"] == r["want"]


def test_support(spark):
    """An echo kept by one translation and not by the other; a translation without one of the verses isn't asked."""
    e = spark.createDataFrame([("virgin", 1, 2), ("child", 1, 3)], "echo string, verse_a long, verse_b long")
    t = spark.createDataFrame([("SPL", 1, ["a virgin shall"]), ("SPL", 2, ["a virgin shall"]), ("OTH", 1, ["a young woman"]), ("OTH", 2, ["a virgin shall"]), ("OTH", 3, ["x"])], "translation string, verse_id long, runs array<string>")
    assert {r["echo"]: (r["kept"], r["asked"]) for r in J.support(e, t).collect()} == {"virgin": (1, 2), "child": (0, 1)}


def test_majority_and_assignment(spark):
    u = spark.createDataFrame([("r", "sacred"), ("r", "body"), ("s", "wealth"), ("s", "wealth"), ("s", "sacred"), ("t", "b"), ("t", "a")], "root string, category string")
    assert {r["root"]: r["category"] for r in J.majority(u).collect()} == {"r": "sacred", "s": "wealth", "t": "a"}
    s = spark.createDataFrame([("n1", "c1", 0.9), ("n1", "c2", 0.1), ("n2", "c1", 0.8), ("n3", "c3", 0.1)], "name string, context string, share double")
    assert {tuple(r) for r in J.assign(s, 0.2).collect()} == {("n1", "c1")}


def test_predictions_and_losses(spark):
    e = spark.createDataFrame([("a", "B", 10, 12), ("b", "B", 20, 21), ("c", "B", 50, 51), ("d", "C", 10, 12)], "prediction string, book string, first int, last int")
    f = spark.createDataFrame([("B", 12, 13), ("B", 23, 25)], "book string, first int, last int")
    assert {r["prediction"]: r["judgement"] for r in J.predictions(e, f).collect()} == {"a": "hit", "b": "near", "c": "miss", "d": "miss"}
    k, h = spark.createDataFrame([("V", 1), ("V", 2)], "version string, verse_id long"), spark.createDataFrame([("V", 1)], "version string, verse_id long")
    assert [tuple(r) for r in J.lost_verses(k, h).collect()] == [("V", 2)]


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, "g" if i % 2 else "h", float(i % 10)) for i in range(400)], "id long, grp string, v double")
    for r in J.bootstrap(df, "grp", "v").collect():
        assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 1.2


def test_balanced_limit(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("x", "c", 7), ("y", "d", 1), ("y", "e", 1), ("y", "f", 8)], "layer string, root string, weight long")
    r = J.balanced_limit(df).first()
    shares = {w: abs(sum(v for v in (1, 2, 7) if v <= w) / 10 - sum(v for v in (1, 1, 8) if v <= w) / 10) for w in (1, 2, 7, 8)}
    assert r["gap"] == pytest.approx(min(shares.values()))


def test_number_words():
    parts = {"twenty": 20, "five": 5, "hundred": 100, "two": 2, "three": 3}
    assert J.join_number("twenty and five men and two hundred sheep and three".split(), parts) == [25, 200, 3]


def test_half_verses(spark):
    m = spark.createDataFrame([(1, 2, "ole"), (1, 5, "atnach"), (1, 9, None), (2, 4, "atnach"), (2, 8, None), (3, 7, None)], "verse_id long, position int, mark string")
    assert {r["verse_id"]: r["split"] for r in J.half_verses(m).collect()} == {1: 2, 2: 4, 3: 3}
