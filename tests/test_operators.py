"""Operators that SQL doesn't express, and edge cases, on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import align as A, evaluate as E, facts as X, similarity as S, strips as H, tagging as G, versification as V, wordsets as W


def test_windows_do_not_depend_on_blocks(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(f"b{k}", c, v, k * 1000 + c * 50 + v) for k in range(2) for c in range(1, 4) for v in range(1, rnd.randint(6, 14))] + [("short", 1, 1, 9001), ("short", 1, 2, 9002)]
    f = spark.createDataFrame([(*r, 3, 2, 1, 0, ["x", f"r{i % 4}"]) for i, r in enumerate(rows)], "book string, chapter int, verse int, verse_id long, words long, content long, rare long, verbs long, roots array<string>")
    key = lambda df: sorted((r["book"], r["start"], r["verses"], r["words"], tuple(r["roots"])) for r in df.collect())
    whole = key(H.windows(f))
    monkeypatch.setattr(H, "BLOCK", 11)
    assert key(H.windows(f)) == whole
    assert [r[:3] for r in whole if r[0] == "short"] == [("short", 0, 2)]
    assert all(r[2] == 10 for r in whole if r[0] != "short")


def test_spots_join_runs_that_share_half_a_window(spark):
    z = [3, 3, 0, 0, 3, 0, 0, 0, 0, 0, 0, 2.5, -3]
    df = spark.createDataFrame([("b", i, "m", float(v)) for i, v in enumerate(z)], "book string, start int, measure string, z double")
    got = sorted((r["hot"], r["first"], r["last"], r["windows"], r["peak_start"]) for r in H.spots(df).collect())
    assert got == [(False, 12, 21, 1, 12), (True, 0, 13, 3, 0), (True, 11, 20, 1, 11)]


def test_kin_by_triples(spark):
    rnd = random.Random(3)
    verses = {v: rnd.sample(range(40), rnd.randint(2, 7)) for v in range(30)}
    rows = [(v, p, f"r{x}", False, "B") for v, s in verses.items() for p, x in enumerate(s)] + [(100 + i, 0, "common", False, "B") for i in range(2000)]
    books = spark.createDataFrame([("B", "OT")], "book string, testament string")
    got = {(r["verse_a"], r["verse_b"]): r["shared"] for r in S.kin(spark.createDataFrame(rows, "verse_id long, position int, root string, is_stop boolean, book string"), books, limit=100).collect()}
    want = {(a, b): len(set(verses[a]) & set(verses[b])) for a in verses for b in verses if a < b and len(set(verses[a]) & set(verses[b])) >= 3}
    assert got == want and want


def test_empty_text(spark):
    t = spark.createDataFrame([], "verse_id long, position int, surface string, root string, is_stop boolean, book string, chapter int, verse int, language string")
    b = spark.createDataFrame([], "book string, testament string, baseline_group string")
    c = X.chapter_counts(t)
    assert X.weight_scales(c).count() == X.book_keyness(c, b, X.chapter_sizes(t)).count() == X.neighbours(t).count() == X.focus_windows(t).count() == S.kin(t, b).count() == 0


def test_clashing_columns(spark):
    t = spark.createDataFrame([(1, 0, "a", "H1", False, "B", 1, 1, "x", 9), (1, 1, "b", "H2", False, "B", 1, 1, "x", 9)], "verse_id long, position int, surface string, root string, is_stop boolean, book string, chapter int, verse int, neighbour string, n int")
    assert {tuple(r) for r in X.neighbours(t).collect()} == {("B", "H1", "H2", 1), ("B", "H2", "H1", 1)}


def test_substance_and_echo_limits(spark):
    df = spark.createDataFrame([("name saith the LORD",), ("the wife of thy youth",), ("of the and",), ("",)], "p string")
    assert [r[0] for r in df.select(X.substance(F.col("p"))).collect()] == [False, True, False, False]


def test_word_sets_against_brute_force(spark):
    rnd = random.Random(8)
    units = {u: {f"r{rnd.randint(0, 8)}" for _ in range(rnd.randint(1, 6))} for u in range(120)}
    df = spark.createDataFrame([(u, r) for u, s in units.items() for r in s], "unit long, root string")
    got = {tuple(r["members"]): r["support"] for r in W.word_sets(df, W.vocabulary(df, 1), 5, 4).collect()}
    from itertools import combinations
    names = sorted({r for s in units.values() for r in s})
    want = {c: n for k in (2, 3, 4) for c in combinations(names, k) if (n := sum(set(c) <= s for s in units.values())) >= 5}
    assert got == want and len(want) > 20
    flags = {tuple(r["members"]): r["closed"] for r in W.closed(W.word_sets(df, W.vocabulary(df, 1), 5, 4)).collect()}
    assert flags == {c: not any(set(c) < set(o) and len(o) == len(c) + 1 and want[o] == n for o in want) for c, n in want.items()}


def test_kinds_of_sets(spark):
    verses = spark.createDataFrame([(1, ["a", "b", "x"]), (2, ["a", "b"]), (3, ["a", "x", "y", "b", "z", "c"]), (4, ["a", *["q"] * 30, "d"])], "verse_id long, roots array<string>")
    sets = spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],), (["a", "d"],)], "members array<string>").withColumn("size", F.size("members"))
    units = verses.select(F.col("verse_id").alias("unit"), F.explode("roots").alias("root")).distinct()
    got = {"".join(r["members"]): r["kind"] for r in W.kinds(W.occurrences_of(sets, units), verses).collect()}
    assert got == {"ab": "phrase", "abc": "frame", "ad": "constellation"}


def test_alignment_finds_translations(spark):
    rnd = random.Random(4)
    lexicon = {f"s{i}": f"t{i}" for i in range(8)}
    src, tgt = [], []
    for v in range(60):
        for s in rnd.sample(sorted(lexicon), 3):
            src.append((v, s))
            tgt.append((v, lexicon[s]))
    frame = lambda rows: spark.createDataFrame(rows, "verse_id long, word string")
    p = A.ibm1(A.word_pairs(frame(src), frame(tgt)))
    best = {r["s"]: r["t"] for r in p.where("p > 0.4 and s <> 'NULL'").collect()}
    assert best == lexicon
    total = {r["s"]: r["x"] for r in p.groupBy("s").agg(F.sum("p").alias("x")).collect()}
    assert all(x == pytest.approx(1) for x in total.values())


@pytest.mark.parametrize("block, sources", [(1 << 21, 1 << 22), (40, 1 << 22), (1 << 21, 1)])
def test_alignment_by_task_and_by_windows(spark, monkeypatch, block, sources):
    """The same probabilities whether pairs are summed in a task, partly so, or by windows."""
    rnd = random.Random(9)
    rows = [(v, s, t, rnd.randint(1, 2)) for v in range(30) for s in rnd.sample(["NULL", *"abcdefg"], 4) for t in rnd.sample("uvwxyz", 3)]
    monkeypatch.setattr(A, "BLOCK", block)
    monkeypatch.setattr(A, "SOURCES", sources)
    p = {(s, t): 1.0 for _, s, t, _ in rows}
    for _ in range(3):
        total, c = {}, {}
        for v, s, t, _ in rows:
            total[v, t] = total.get((v, t), 0) + p[s, t]
        for v, s, t, n in rows:
            c[s, t] = c.get((s, t), 0) + n * p[s, t] / total[v, t]
        every = {s: sum(x for (y, _), x in c.items() if y == s) for s, _ in c}
        p = {k: x / every[k[0]] for k, x in c.items()}
    got = {(r["s"], r["t"]): r["p"] for r in A.ibm1(spark.createDataFrame(rows, "verse_id long, s string, t string, n long"), 3).collect()}
    assert got.keys() == p.keys() and all(got[k] == pytest.approx(p[k]) for k in p)
    assert A.ibm1(spark.createDataFrame([], "verse_id long, s string, t string, n long")).count() == 0


def test_companions_outliers_and_moments(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(260, 5))
    x[:, 1:3] += 2 * x[:, :1]
    x[7] += 30
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, vector array<double>")
    n, mean, cov = E.moments(df)
    assert n == 260 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    d = {r["id"]: r["distance"] for r in E.mahalanobis(df).collect()}
    assert max(d, key=d.get) == 7 and len(d) == 260
    sd = np.sqrt(np.diag(cov))
    z = np.clip((x - mean) / sd, -6, 6)
    m, s = z.mean(0), np.cov(z.T, bias=True)
    ball = np.trace(s) / 5 * np.eye(5)
    noise = np.mean([((np.outer(r, r) - s) ** 2).sum() for r in z - m]) / 260
    share = min(1.0, noise / ((s - ball) ** 2).sum())
    inv = np.linalg.inv((1 - share) * s + share * ball)
    assert 0 < share < 1 and all(d[i] == pytest.approx(((x[i] - mean) / sd - m) @ inv @ ((x[i] - mean) / sd - m)) for i in range(260))
    flat = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, vector array<double>")  # one coordinate that doesn't vary
    assert all(np.isfinite(r["distance"]) for r in E.mahalanobis(flat).collect())
    got = {(r["a"], r["rank"]): r["b"] for r in E.companions(df, 3).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for a in (0, 100, 200):
        order = [b for b in np.argsort(1 - u[a] @ u.T) if b != a]
        assert [got[a, k] for k in (1, 2, 3)] == order[:3]
    assert E.companions(df.limit(0), 3).count() == 0 and E.mahalanobis(df.limit(0)).count() == 0


def test_local_outlier(spark):
    pts = [0.0, 0.1, 0.2, 0.3, 5.0]
    pairs = spark.createDataFrame([(a, b, abs(x - y)) for a, x in enumerate(pts) for b, y in enumerate(pts) if a != b], "a long, b long, distance double")
    lof = {r["a"]: r["lof"] for r in E.local_outlier(E.nearest(pairs, 2)).collect()}
    assert max(lof, key=lof.get) == 4 and lof[4] > 5 > lof[1]


def test_running_totals_need_no_single_sort(spark):
    from quillmark.operators.order import places, running

    rnd = random.Random(5)
    values = rnd.sample(range(10_000), 700)
    df = spark.createDataFrame([(v, v % 13) for v in values], "v long, w long").repartition(7)
    order = sorted(values)
    assert {r["v"]: r["place"] for r in places(df, [F.col("v")]).collect()} == {v: i for i, v in enumerate(order)}
    up, down = running(df, [F.col("v")], F.col("w"), "x"), running(df, [F.col("v")], F.col("w"), "x", "min", reverse=True)
    sums = dict(zip(order, np.cumsum([v % 13 for v in order]).tolist()))
    assert {r["v"]: r["x"] for r in up.collect()} == sums
    assert {r["v"]: r["x"] for r in down.collect()} == {v: min(x % 13 for x in order[i:]) for i, v in enumerate(order)}
    assert places(df.limit(0), [F.col("v")]).count() == 0


def test_corrected_p_values(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, 0.04])], "id long, p double")
    got = {r["id"]: r["q"] for r in E.false_discovery(df).collect()}
    assert got == {0: pytest.approx(0.05), 1: pytest.approx(0.05), 2: pytest.approx(0.05), 3: pytest.approx(0.5), 4: pytest.approx(0.05)}
    ev = {r["id"]: r["e"] for r in E.empirical_p(df.select("id", F.col("p").alias("v")), "v").select("id", F.col("p").alias("e")).collect()}
    assert ev[3] == pytest.approx(1 / 6) and ev[0] == pytest.approx(5 / 6)


def test_shuffle_test_tells_signal_from_noise(spark):
    rnd = random.Random(1)
    rows = [(i, i % 2 == 0, rnd.gauss(0, 1) + (3 if i % 2 == 0 else 0), rnd.gauss(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g boolean, signal double, noise double")
    assert E.shuffle_test(df, "g", "signal").first()["p"] < 0.02
    assert E.shuffle_test(df, "g", "noise").first()["p"] > 0.02
    assert E.shuffle_test(df, "g", "signal").first() == E.shuffle_test(df.repartition(5), "g", "signal").first()
    three = df.withColumn("l", F.when(F.col("id") < 20, "a").when(F.col("id") < 100, "b").otherwise("c")).withColumn("v", F.col("noise") + F.when(F.col("l") == "a", 3).otherwise(0))
    got = {r["label"]: r for r in E.shuffle_tests(three, "l", "v", 50).collect()}
    data = [(r["id"], r["l"], r["v"]) for r in three.collect()]
    for label, r in got.items():
        mine, rest = [v for _, x, v in data if x == label], [v for _, x, v in data if x != label]
        assert r["observed"] == pytest.approx(np.mean(mine) - np.mean(rest)) and r["times"] == 50
        above = 0
        for t in range(1, 51):
            u = E.uniform(np.array([i for i, _, _ in data]), t, 7) < len(mine) / len(data)
            v = np.array([x for _, _, x in data])
            above += v[u].mean() - v[~u].mean() >= r["observed"]
        assert r["above"] == above
    assert set(got) == {"a", "b", "c"} and got["a"]["p"] < 0.05 and E.shuffle_tests(three.limit(0), "l", "v").count() == 0


def test_factors_and_structures():
    rnd = np.random.default_rng(3)
    m = rnd.random((12, 3)) @ rnd.random((3, 20))
    w, h = E.factorise(m, 3, 2000)
    assert np.abs(w @ h - m).max() < 0.02 and w.min() >= 0 and h.min() >= 0
    assert E.best_chain(list("abcXcba")) == [(0, 6), (1, 5), (2, 4)] and E.best_chain(list("abc")) == []
    assert E.best_frame(list("abxxa"), {"a": 1.0, "x": 1.5}) == (0, 4, 4.0) and E.best_frame([], {}) == (-1, -1, 0.0)
    assert E.best_centre([{1}, {2}, {9}, {2}, {1}])[0] == 4


def test_placing_tags(spark):
    words = ["in", "the", "beginning", "god", "created"]
    assert G.place_tags(words, [(2, "H1"), (3, "H2"), (4, "H3")]) == {2: "H1", 3: "H2", 4: "H3"}
    fits = lambda w, n: {"H1": "beginning", "H2": "god"}.get(n, w) == w
    assert G.place_tags(words, [(0, "H1"), (1, "H2"), (2, "H3")], fits) == {2: "H1", 3: "H2", 4: "H3"}
    w = spark.createDataFrame([(1, i, x) for i, x in enumerate(words)], "verse_id long, position int, surface string")
    t = spark.createDataFrame([(1, 2, "H1"), (1, 3, "H2")], "verse_id long, stated int, number string")
    assert {(r["position"], r["number"]) for r in G.place_tags_by_verse(w, t).collect()} == {(2, "H1"), (3, "H2")}


def test_inferring_tags(spark):
    rows = [(v, 0, "son", "H1", False, "B") for v in range(4)] + [(9, 0, "son", "son", False, "B"), (10, 0, "son", "son", False, "C"), (11, 0, "hath", "hath", False, "B")]
    df = spark.createDataFrame(rows, "verse_id long, position int, surface string, root string, is_stop boolean, book string")
    assert {(r["verse_id"], r["inferred"]) for r in G.infer(df).collect()} == {(9, "H1"), (10, "H1")}


def test_numbering(spark):
    v = spark.createDataFrame([("P", 3, 1, "head"), ("P", 3, 2, "first"), ("J", 2, 1, "x"), ("K", 1, 1, "y")], "book string, chapter int, verse int, text string")
    vm = spark.createDataFrame([("P", 3, 1, 3, 1), ("P", 3, 2, 3, 1)], "book string, chapter int, verse int, to_chapter int, to_verse int")
    cm = spark.createDataFrame([("J", 2, 3)], "book string, chapter int, to_chapter int")
    out = V.renumbered(v, vm, cm)
    assert {(r["book"], r["verse"]): (r["to_chapter"], r["to_verse"], r["mapped"]) for r in out.collect()} == {("P", 1): (3, 1, "verse"), ("P", 2): (3, 1, "verse"), ("J", 1): (3, 1, "chapter"), ("K", 1): (1, 1, "same")}
    assert {(r["book"], r["chapter"], r["verse"]): r["text"] for r in V.joined_texts(out).collect()}["P", 3, 1] == "head first"
    assert {r["book"]: r["missing"] for r in V.map_check(vm, v).collect()} == {"P": 0}


def test_conditions():
    lengths = {("Gen", 1, 1): 10, ("Gen", 1, 2): 25}
    assert V.holds("Gen.1:1=Exist & Gen.1:3=NotExist & Gen.1:2=Last", lengths) and V.holds("Gen.1:1 < Gen.1:2", lengths) and V.holds("Gen.1:2 > Gen.1:1*2", lengths)
    assert not V.holds("Gen.1:2 > Gen.1:1*3", lengths) and not V.holds("Gen.1:9 > Gen.1:1", lengths)
    with pytest.raises(ValueError):
        V.holds("nonsense", lengths)


def test_sections_families_roots_and_peaks(spark):
    ch = spark.createDataFrame([("B", c) for c in range(1, 6)], "book string, chapter int")
    s = V.sections(ch, spark.createDataFrame([("B", "Law", 2, 3)], "book string, section string, first int, last int"))
    assert {(r["section"], r["first"], r["last"]) for r in V.seams(s).collect()} == {("Law", 2, 3), ("Rest of B", 1, 5)}
    pairs = spark.createDataFrame([("a", "b", 0.1), ("b", "c", 0.1), ("c", "d", 0.9), ("d", "e", 0.1)], "a string, b string, distance double")
    assert {r["member"]: r["family"] for r in V.closest_family(pairs, 0.2).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    links = spark.createDataFrame([("r1", "r2"), ("r2", "r3"), ("r3", None), ("r4", "Name")], "root string, parent string")
    assert {r["root"]: r["family"] for r in V.root_families(links, ["Name"]).collect()} == {"r1": "r3", "r2": "r3", "r3": "r3", "r4": "r4"}
    vals = spark.createDataFrame([("b", i, float(x)) for i, x in enumerate([1, 3, 2, 3, 0, 5])], "g string, i long, v double")
    assert sorted(r["i"] for r in V.local_peaks(vals, "g", "i", "v", 2).collect()) == [1, 5]
    scored = spark.createDataFrame([(1, "x", 2), (1, "y", 3), (2, "b", 1), (2, "a", 1)], "record long, column_name string, score int")
    assert {r["record"]: r["column_name"] for r in V.best_column(scored).collect()} == {1: "y", 2: "a"}


def test_rendered_runs():
    assert S.render_run("a b c d".split(), "a b c d".split()) == "a b c d"
    assert S.render_run("a b c d".split(), "a x c d".split()) == "a [b / x] c d"
    assert S.render_run("a b d".split(), "a b c d".split()) == "a b [- / c] d" and S.render_run([], ["x"]) == "[- / x]"


def test_rules_of_gloss_and_chapter(spark):
    t = spark.createDataFrame([("H1", "a lion", "B", 1), ("H1", "to be", "B", 1), ("H1", None, "B", 1), ("H2", "x", "B", 3), ("H2", "x", "B", 9), ("H2", "x", "C", 3), ("H3", None, None, None)], "root string, gloss string, book string, chapter int")
    rules = spark.createDataFrame([("H1", "Lion", None, None, None), ("H2", None, "B", 2, 4)], "root string, gloss string, book string, chapter_from int, chapter_to int")
    assert {tuple(r) for r in G.allowed(t, rules).collect()} == {("H1", "a lion", "B", 1), ("H2", "x", "B", 3), ("H3", None, None, None)}
