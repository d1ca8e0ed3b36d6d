"""Queries that do the whole job, on a small planted corpus."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillmark.plans import registry

Q = registry.queries()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Three books of six chapters of ten verses; five roots travel together in two of them, at the ends of the first."""
    d = str(tmp_path_factory.mktemp("corpus"))
    rnd = random.Random(11)
    verses, tokens = [], []
    for k, book in enumerate("ABC"):
        for c in range(1, 7):
            for v in range(1, 11):
                i = k * 1000 + c * 50 + v
                verses.append((i, book, c, v, "x", "t", "w", "p"))
                roots = [f"H{rnd.randint(10, 60)}" for _ in range(rnd.randint(2, 6))]
                if (book == "A" and c in (1, 6)) or (book == "B" and v == 5):
                    roots += ["H1", "H2", "H3", "H4", *(["H5"] if v % 3 else [])]
                if book == "C" and c in (2, 3):
                    roots += ["H91", "H92", "H93", "H94"]
                rnd.shuffle(roots)
                tokens += [(i, p, r.lower(), r.lower(), r, r, "N", p == 99) for p, r in enumerate(roots)]
    spark.createDataFrame(verses, "verse_id long, book string, chapter int, verse int, language string, text string, word_string string, phrase_string string").write.parquet(f"{d}/verses.parquet")
    spark.createDataFrame(tokens, "verse_id long, position int, surface string, lemma string, root string, strongs string, morph string, is_stop boolean").write.parquet(f"{d}/tokens.parquet")
    spark.createDataFrame([("A", 1, "OT", "g"), ("B", 2, "OT", "g"), ("C", 3, "OT", "g")], "name string, book_num int, testament string, baseline_group string").write.parquet(f"{d}/books.parquet")
    held = {}
    for i, _, _, _, r, *_ in tokens:
        held.setdefault(i, set()).add(r)
    return d, held, {v[0]: v[1:4] for v in verses}


def brute_force(held, least):
    """Members to the verses that hold them, of all sets of two to five roots of 20 verses or more that stand in ``least`` verses."""
    once = {r: sum(r in s for s in held.values()) for s in held.values() for r in s}
    vocab = {r for r, n in once.items() if n >= 20}
    at = {}
    for i, s in held.items():
        for k in (2, 3, 4, 5):
            for m in combinations(sorted(s & vocab), k):
                at.setdefault(m, set()).add(i)
    return {" ".join(m): v for m, v in at.items() if len(v) >= least}


def test_word_sets_of_all_sizes(spark, corpus):
    d, held, _ = corpus
    want = brute_force(held, 6)
    got = {r["members"]: (r["size"], r["support"]) for r in Q["word_sets_all"](spark, d).collect()}
    assert got == {m: (len(m.split()), len(v)) for m, v in want.items()}
    assert got["H1 H2 H3 H4 H5"][0] == 5
    small = {tuple(r) for r in Q["word_sets"](spark, d).collect()}
    assert small == {tuple(r) for r in Q["word_sets_all"](spark, d).where("size <= 3").collect()}


def test_closed_sees_sets_of_four_and_five(spark, corpus):
    d, *_ = corpus
    got = {r["members"]: (r["support"], r["closed"]) for r in Q["constellations_all"](spark, d).collect()}
    for m, (n, closed) in got.items():
        assert closed == (not any(set(m.split()) < set(o.split()) and len(o.split()) == len(m.split()) + 1 and k == n for o, (k, _) in got.items()))
    assert not got["H1 H2 H3"][1] and got["H1 H2 H3 H4"][1] and got["H1 H2 H3 H4 H5"][1]
    assert Q["constellations"](spark, d).where("members = 'H1 H2 H3'").first()["closed"]


def test_kinds_and_places_of_all_sizes(spark, corpus):
    d, held, place = corpus
    want = brute_force(held, 6)
    kinds = {r["members"] for r in Q["set_kinds"](spark, d).collect()}
    assert "H1 H2 H3 H4 H5" in kinds and "H1 H2 H3 H4" in kinds
    number = {i: n for b in "ABC" for n, i in enumerate(sorted(i for i, p in place.items() if p[0] == b))}
    places = {}
    for m, at in want.items():
        for b in {place[i][0] for i in at}:
            n = sorted(number[i] for i in at if place[i][0] == b)
            places[m, b] = 1 + sum(y - x > 1 for x, y in zip(n, n[1:]))
    assert {(r["members"], r["book"]): r["places"] for r in Q["set_places_all"](spark, d).collect()} == places
    ends = {(r["members"], r["book"]) for r in Q["set_inclusio_all"](spark, d).collect()}
    assert ("H1 H2 H3 H4 H5", "A") in ends and ("H1 H2 H3 H4", "A") in ends and not any(b == "B" and m.startswith("H1 H2") for m, b in ends)


def test_books_against_layer_of_all_sizes(spark, corpus):
    d, held, place = corpus
    want = {}
    for m, at in brute_force(held, 8).items():
        for b in "ABC":
            n = sum(place[i][0] == b for i in at)
            if n >= 8 and n * 180 >= 3 * len(at) * 60:
                want[b, m] = (n, len(at))
    got = {(r["book"], r["members"]): (r["n"], r["all_n"]) for r in Q["books_against_layer_all"](spark, d).collect()}
    assert got == want and ("C", "H91 H92 H93 H94") in got
    pairs = {(r["book"], f"{r['root_a']} {r['root_b']}"): (r["n"], r["all_n"]) for r in Q["books_against_layer"](spark, d).collect()}
    assert pairs == {k: v for k, v in got.items() if k[1].count(" ") == 1}


def test_contexts_of_windows_and_verses(spark, tmp_path):
    """Two topics, each with 400 roots of its own: more than 500 in all, each verse from one of them."""
    d, rnd = str(tmp_path), random.Random(4)
    verses, tokens = [], []
    for k, book in enumerate("AB"):
        for i in range(400):
            topic = (i // 40 + k) % 2
            verses.append((k * 1000 + i, book, 1 + i // 40, i % 40 + 1, "x"))
            tokens += [(k * 1000 + i, p, "s", "l", f"H{topic}{rnd.randrange(400):03d}", "H", "N", False) for p in range(10)]
    verses += [(5000 + v, "S", 1, v + 1, "x") for v in range(3)]
    tokens += [(5000 + v, 0, "s", "l", "H0001", "H", "N", False) for v in range(2)]
    spark.createDataFrame(verses, "verse_id long, book string, chapter int, verse int, language string").write.parquet(f"{d}/verses.parquet")
    spark.createDataFrame(tokens, "verse_id long, position int, surface string, lemma string, root string, strongs string, morph string, is_stop boolean").write.parquet(f"{d}/tokens.parquet")
    w = Q["window_contexts"](spark, d).toPandas()
    assert len(w) == 6 * (391 + 391 + 1) and set(w[w.book == "S"].start) == {0}
    assert w.groupby(["book", "start"]).share.sum().between(0.999, 1.001).all()
    v = Q["verse_contexts"](spark, d).toPandas().pivot(index="verse_id", columns="context", values="share")
    assert len(v) == 803 and v.loc[5002].sum() == 0 and v.drop(5002).sum(axis=1).between(0.999, 1.001).all()
    topic = {i: (i % 1000 // 40 + i // 1000) % 2 for i in v.index if i < 5000}
    of = {c: v.loc[[i for i in topic if topic[i] == 0], c].mean() > v.loc[[i for i in topic if topic[i] == 1], c].mean() for c in v}
    right = [v.loc[i, [c for c in of if of[c] == (t == 0)]].sum() > 0.5 for i, t in topic.items()]
    assert sum(right) > 0.97 * len(right)
    b = Q["contexts"](spark, d).toPandas()
    mean = w.groupby(["book", "context"]).share.mean()
    assert len(b) == 18 and all(abs(mean[r.book, r.context] - r.share) < 2e-4 for r in b.itertuples())


def test_factors_rebuild_as_well_as_on_one_machine(spark):
    import numpy as np

    from quillmark.operators import contexts as K, evaluate as E

    rnd = np.random.default_rng(2)
    m = rnd.random((90, 3)) @ rnd.random((3, 40)) * (rnd.random((90, 40)) < 0.5)
    rows = [(i, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for i, r in enumerate(m)]
    df = spark.createDataFrame(rows, "id long, at array<int>, x array<double>")
    h = K.fit(df, 40, 3)
    w = K._mix(h, 90, *K._flat(df.toArrow().combine_chunks().to_batches()[0].select(["at", "x"])))
    one, other = E.factorise(m, 3, 2000)
    assert np.linalg.norm(m - w @ h) <= 1.02 * np.linalg.norm(m - one @ other)


def test_chapter_structures(spark, tmp_path):
    """Verses mirror each other by roots that aren't their first; against the best of all nested chains."""
    d, rnd = str(tmp_path), random.Random(6)
    units = {(1, v): [f"H{rnd.randint(500, 999)}", f"H{x}", f"H{rnd.randint(1000, 9999)}"] for v, x in enumerate([1, 2, 3, 9, 3, 2, 1], 1)}
    units |= {(c, v): [f"H{rnd.randint(100, 400)}" for _ in range(4)] for c in range(2, 12) for v in range(1, 11)}
    verses = [(c * 100 + v, "B", c, v, "x") for c, v in units]
    tokens = [(c * 100 + v, p, "s", "l", r, r, "N", False) for (c, v), u in units.items() for p, r in enumerate(u)]
    spark.createDataFrame(verses, "verse_id long, book string, chapter int, verse int, language string").write.parquet(f"{d}/verses.parquet")
    spark.createDataFrame(tokens, "verse_id long, position int, surface string, lemma string, root string, strongs string, morph string, is_stop boolean").write.parquet(f"{d}/tokens.parquet")
    import math

    df = {}
    for u in units.values():
        for r in set(u):
            df[r] = df.get(r, 0) + 1
    idf = {r: math.log(len(units) / n) for r, n in df.items()}

    def weight(us, i, j):
        theme = {r for u in us for r in u if len(us) >= 6 and 3 * sum(r in set(x) for x in us) > len(us)}
        shared = {r for r in set(us[i]) & set(us[j]) if idf[r] >= 2 and r not in theme}
        runs = set(zip(us[i], us[i][1:])) & set(zip(us[j], us[j][1:]))
        return sum(idf[r] for r in shared) + sum((idf[a] + idf[b]) / 2 for a, b in runs if a in shared and b in shared)

    def best(us, i, j):
        return 0.0 if i >= j else max(best(us, i + 1, j), best(us, i, j - 1), best(us, i + 1, j - 1) + weight(us, i, j))

    got = {r["chapter"]: r for r in Q["chapter_chains"](spark, d).collect()}
    for c in (1, 2, 3):
        us = [u for (k, _), u in units.items() if k == c]
        assert got[c]["verses"] == len(us) and got[c]["weight"] == pytest.approx(best(us, 0, len(us) - 1), abs=1e-5)
    assert got[1]["pairs"] == 3
    centre = {r["chapter"]: (r["first"], r["last"]) for r in Q["chapter_centres"](spark, d).collect()}
    frame = {r["chapter"]: (r["first"], r["last"]) for r in Q["chapter_frames"](spark, d).collect()}
    assert centre[1] == (4, 4) and frame[1] == (1, 7)


def test_set_phrases_are_counted_by_verse(spark):
    from quillmark.plans.manner_queries import phrase_uses

    rows = [(1, "and it was unto this day and to this day".split()), (2, "in that day in that day".split()), (3, "of the day".split()), (4, []), (5, None)]
    got = {(r["verse_id"], r["phrase"]): r["uses"] for r in phrase_uses(spark.createDataFrame(rows, "verse_id long, words array<string>")).collect()}
    assert got == {(1, "unto this day"): 2, (2, "in that day"): 1}  # a blank is shared, so the second is not counted


def test_warm_spots_keep_clear_of_hot_ones(spark):
    from quillmark.operators.strips import bands

    z = [0, 2.5, 2.5, 4, 2.5, 0, *[0] * 12, 2.2, 2.4, 0, *[0] * 12, -4, -3.5, 0]
    df = spark.createDataFrame([("B", "m", i, float(x)) for i, x in enumerate(z)], "book string, measure string, start int, z double")
    got = {(r["band"], r["first"], r["last"], r["peak"]) for r in bands(df, 2.0, 3.3).collect()}
    assert got == {("hot", 3, 12, 4.0), ("warm", 18, 28, 2.4), ("cool", 33, 43, -4.0)}
