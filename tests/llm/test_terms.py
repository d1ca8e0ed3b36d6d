"""Divergence scores, basket pairs, suffix-array counts and the set join against brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest

from quillmark.llm.distinctive import distinctive_terms
from quillmark.llm.frequency import ngram_counts
from quillmark.llm.pairs import co_occurring
from quillmark.llm.setjoin import similar_links, similar_pairs


def test_distinctive_scores(spark):
    rows = [("x", "a", 3, "clash"), ("x", "a", 2, "clash"), ("x", "b", 1, ""), ("y", "b", 4, ""), (None, "b", 9, ""), ("y", None, 9, ""), ("y", "c", 0, "")]
    df = spark.createDataFrame(rows, "record string, term string, n long, score string")
    got = {(r["record"], r["term"]): r for r in distinctive_terms(df, "record", "term", mu=10.0, min_df=1).collect()}
    assert set(got) == {("x", "a"), ("x", "b"), ("y", "b")}
    pc, pd = 5 / 10, (5 + 10 * 5 / 10) / (6 + 10)
    assert got["x", "a"]["score"] == pytest.approx(pd * math.log(pd / pc))
    assert {(r["record"], r["term"]) for r in distinctive_terms(df, "record", "term", min_df=2).collect()} == {("x", "b"), ("y", "b")}
    assert distinctive_terms(df.limit(0), "record", "term").count() == 0


@pytest.mark.parametrize("widest", [512, 3])
def test_pairs_against_brute_force(spark, widest):
    rnd = random.Random(5)
    rows = [(b, f"i{rnd.randint(0, 25)}") for b in range(120) for _ in range(rnd.randint(0, 7))]
    rows += [(b, x) for b in range(200, 208) for x in ("q", "r", "s", "t")] + [(500, None), (None, "q")]
    rows += rows[:40]
    got = {(r["item_a"], r["item_b"]): (r["together"], round(r["lift"], 9), r["conviction"]) for r in co_occurring(spark.createDataFrame(rows, "basket long, item string"), "basket", "item", 3, 2, widest).collect()}
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            baskets[b].add(i)
    n, one, two = len(baskets), Counter(), Counter()
    for s in baskets.values():
        one.update(s)
        two.update(itertools.combinations(sorted(s), 2))
    want = {p: (k, round(k * n / (one[p[0]] * one[p[1]]), 9)) for p, k in two.items() if k >= 3 and k * n >= 2 * one[p[0]] * one[p[1]]}
    assert {p: v[:2] for p, v in got.items()} == want and len(want) > 3
    assert got["q", "r"][2] is None  # never apart


def test_pairs_empty(spark):
    assert co_occurring(spark.createDataFrame([], "basket long, item string"), "basket", "item").count() == 0


@pytest.mark.parametrize("segment, n_max, key", [(8192, 3, "long"), (5, 3, "long"), (5, 3, "string"), (8192, None, "string")])
def test_ngrams_against_brute_force(spark, segment, n_max, key):
    rnd = random.Random(3)
    rows = []
    for rec in (i if key == "long" else f"r{i}" for i in range(40)):
        for pos in range(rnd.randint(0, 17)):
            if rnd.random() < 0.93:
                rows.append((rec, pos, rnd.choice(["a", "b", "c", "", None]), rnd.choice("xy")))
    rows += [("long" if key == "string" else 77, pos, "a", "xy"[pos % 7 == 0]) for pos in range(60)]
    df = spark.createDataFrame(rows, f"rec {key}, position int, t string, gram string")
    got = {(r["field"], tuple(r["gram"])): (r["occurrences"], r["records"]) for r in ngram_counts(df, "rec", "position", ["t", "gram"], n_max, segment).collect()}
    tf, df_ = Counter(), defaultdict(set)
    for field, k in (("t", 2), ("gram", 3)):
        at = {(r[0], r[1]): r[k] for r in rows}
        for (rec, pos), _ in at.items():
            for n in range(1, (n_max or 60) + 1):
                g = tuple(at.get((rec, pos + j)) for j in range(n))
                if None not in g:
                    tf[field, g] += 1
                    df_[field, g].add(rec)
    assert got == {k: (v, len(df_[k])) for k, v in tf.items()}


def test_ngrams_empty(spark):
    assert ngram_counts(spark.createDataFrame([], "rec long, position int, t string"), "rec", "position", ["t"], 2).count() == 0


def _brute(sets, least):
    return {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if min(len(x), len(y)) >= least and 5 * len(x & y) >= 4 * len(x | y)}


def test_set_join_against_brute_force(spark):
    rnd = random.Random(11)
    sets = {}
    for i in range(240):
        if i % 3 and sets and rnd.random() < 0.7:
            s = set(rnd.choice([x for x in sets.values() if x]))
            for _ in range(rnd.randint(0, 3)):
                s.add(f"w{rnd.randint(0, 60)}")
                if len(s) > 3 and rnd.random() < 0.5:
                    s.remove(rnd.choice(sorted(s)))
        else:
            s = {f"w{int(rnd.paretovariate(0.6)) % 60}" for _ in range(rnd.randint(1, 30))}
        sets[i] = s
    for i in range(300, 306):  # longer than the border of the schemes, and on both sides of it
        sets[i] = {f"z{k}" for k in range(55 + (i - 300) * 3)}
    rows = [(i, [*s, *list(s)[:2]], "clash") for i, s in sets.items()] + [(900, None, ""), (None, ["a"] * 9, ""), (901, [], ""), (902, [None, "a"], "")]
    df = spark.createDataFrame(rows, "id long, items array<string>, digest string")
    got = {(r["id_a"], r["id_b"]): r for r in similar_pairs(df, 4).collect()}
    want = _brute(sets, 4)
    assert set(got) == want and len(want) > 20
    for (a, b), r in got.items():
        assert (r["overlap"], r["size_a"], r["size_b"]) == (len(sets[a] & sets[b]), len(sets[a]), len(sets[b]))
    links = {r["id"]: r for r in similar_links(df, 4).collect()}
    assert set(links) == {i for i, s in sets.items() if len(s) >= 4}
    same = {(a, b) for a, b in want if sets[a] == sets[b]}
    assert all(links[a]["class_id"] == links[b]["class_id"] for a, b in same)
    partners = defaultdict(set)
    for a, b in want - same:
        partners[a].add(links[b]["class_id"])
        partners[b].add(links[a]["class_id"])
    assert all(r["links"] == len(partners[i]) for i, r in links.items())


def test_set_join_empty(spark):
    assert similar_pairs(spark.createDataFrame([], "id long, items array<string>"), 1).count() == 0


def test_common_terms_use_combinations(spark):
    """With few terms every prefix is common, so pairs come from combinations of two and three."""
    rnd = random.Random(2)
    sets = {i: frozenset(rnd.sample(range(14), rnd.randint(8, 12))) for i in range(700)}
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, items array<string>")
    assert {(r["id_a"], r["id_b"]) for r in similar_pairs(df, 8).collect()} == _brute(sets, 8)


@pytest.mark.parametrize("num, den", [(3, 10), (1, 2), (2, 3), (9, 10), (1, 1), (1, 20)])
def test_set_join_at_any_threshold(spark, num, den):
    """Small and large sets, one term in nearly all of them; nothing is lost at any threshold."""
    rnd = random.Random(num * 31 + den)
    sets = {0: {"c"}} | {i: {"c", f"x{i}"} for i in range(1, 41)}
    for i in range(100, 260):
        base = set(rnd.choice(list(sets.values()))) if rnd.random() < 0.6 else {f"w{int(rnd.paretovariate(0.7)) % 90}" for _ in range(rnd.choice([1, 2, 3, 5, 9, 20, 70, 100]))}
        sets[i] = base | {"c"} | {f"w{rnd.randint(0, 89)}" for _ in range(rnd.randint(0, 2))}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<string>")
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if den * len(x & y) >= num * len(x | y)}
    assert {(r["id_a"], r["id_b"]) for r in similar_pairs(df, 1, num, den).collect()} == want
