"""Sets searched root by root: all roots take part, and what is asked of a set is answered as by brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions.sequences import smallest_window
from quillmark.operators import grown as G, wordsets as W
from quillmark.plans import registry
from tests.oracle import assert_same, connect

Q = registry.queries()


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A thousand verses of 697 roots, each in about thirty, and three roots in twenty verses at both ends of book A: the rarest of 700."""
    d, rnd = str(tmp_path_factory.mktemp("many")), random.Random(5)
    verses, tokens = [], []
    for book, n, first in (("A", 300, 0), ("B", 700, 1000)):
        for k in range(n):
            i, chapter = first + k, 1 + k // 30
            verses.append((i, book, chapter, k % 30 + 1, "x", "t", "w", "p"))
            roots = [f"H{r}" for r in rnd.sample(range(697), 22)]
            if book == "A" and (k < 12 or k >= 292):
                roots[5:5] = ["Z1", "Z2", "Z3"]
            tokens += [(i, p, r.lower(), r.lower(), r, r, "N", False) for p, r in enumerate(roots)]
    spark.createDataFrame(verses, "verse_id long, book string, chapter int, verse int, language string, text string, word_string string, phrase_string string").coalesce(1).write.parquet(f"{d}/verses.parquet")
    spark.createDataFrame(tokens, "verse_id long, position int, surface string, lemma string, root string, strongs string, morph string, is_stop boolean").coalesce(1).write.parquet(f"{d}/tokens.parquet")
    spark.createDataFrame([("A", 1, "OT", "g"), ("B", 2, "OT", "g")], "name string, book_num int, testament string, baseline_group string").coalesce(1).write.parquet(f"{d}/books.parquet")
    return d


def _only_z(df):
    return sorted(tuple(r) for r in df.where("members like 'Z%'").collect())


Z = ["Z1 Z2", "Z1 Z2 Z3", "Z1 Z3", "Z2 Z3"]


def test_kinds_of_more_than_600_roots(spark, many):
    assert _only_z(Q["set_kinds"](spark, many).select("members", "kind")) == [(m, "constellation" if m == "Z1 Z3" else "phrase") for m in Z]


def test_places_of_more_than_600_roots(spark, many):
    assert _only_z(Q["set_places_all"](spark, many).select("members", "book", "places")) == [(m, "A", 2) for m in Z]


def test_inclusio_of_more_than_600_roots(spark, many):
    assert _only_z(Q["set_inclusio_all"](spark, many).select("members", "book")) == [(m, "A") for m in Z]


def test_books_against_layer_of_more_than_600_roots(spark, many):
    assert _only_z(Q["books_against_layer_all"](spark, many).select("members", "book", "n", "all_n")) == [(m, "A", 20, 20) for m in Z]


@pytest.mark.parametrize("name", ["set_places", "set_inclusio"])
def test_pairs_keep_to_their_sql(spark, many, name):
    """Which takes 600 of these 700 roots."""
    con = connect(many)
    for t in ("verses", "tokens", "books"):
        con.execute(f"create or replace view {t} as select * from '{many}/{t}.parquet/*.parquet'")
    assert_same(Q[name](spark, many), con, registry.oracle_sql()[name])


def test_grown_in_pieces_is_brute_force():
    rnd = random.Random(2)
    rows = sorted((sorted(rnd.sample(range(12), rnd.randint(2, 8))) for _ in range(300)), key=lambda r: r[0])
    want = {}
    for i, r in enumerate(rows):
        for k in (2, 3, 4, 5):
            for m in combinations(r[1:], k - 1):
                want.setdefault((r[0], *m), []).append(i)
    want = {m: at for m, at in want.items() if len(at) >= 4}
    starts = np.cumsum([0, *map(len, rows)])
    items = np.concatenate(rows)
    for most in (1, 50, 10**6):
        got = {}
        for sets, first, row, path in G.grown(starts, items, 4, 5, most):
            assert (items[path] == np.repeat(sets, np.diff(np.append(first, len(row))), axis=0)).all()
            for m, at in zip(sets, np.split(row, first[1:])):
                assert tuple(m) not in got
                got[tuple(map(int, m))] = at.tolist()
        assert got == want


def test_widths_with_repeated_roots_and_small_blocks(spark, monkeypatch):
    """Roots that stand in a unit more than once: the closest of them count."""
    rnd = random.Random(7)
    units = {i: [rnd.choice("ABCDEFGHIJKL") for _ in range(rnd.randint(2, 16))] for i in range(200)}
    words = spark.createDataFrame([(i, r, k) for i, x in units.items() for k, r in enumerate(x)], "unit int, root string, at int")
    v = W.vocabulary(words.select("unit", "root").distinct(), 5, None)
    monkeypatch.setattr(G, "ROWS", 7)
    monkeypatch.setattr(G, "MIN_LIFT", {2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0})
    rows = G.by_root(words, v, None, [], at=True)
    assert rows.count() <= sum(len(set(x)) for x in units.values())
    got = {r["members"]: (r["size"], r["support"], r["tight"], r["near"]) for r in G.widths(rows, 5, 3, len(units), 5).collect()}
    want = {}
    for x in units.values():
        for k in (2, 3):
            for m in combinations(sorted(set(x)), k):
                w = smallest_window(x, list(m))
                old = want.get(" ".join(m), (k, 0, 0, 0))
                want[" ".join(m)] = (k, old[1] + 1, old[2] + (w == k), old[3] + (w <= 5))
    assert got == {m: x for m, x in want.items() if x[1] >= 5}
