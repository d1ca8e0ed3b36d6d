"""Parallels: all pairs of verses are judged, in blocks of any size, and no pair of them is shuffled."""

import random
from itertools import permutations

import pyarrow as pa
import pytest

from quillmark.functions.sequences import lcs_length
from quillmark.operators import parallels as P
from quillmark.plans import registry
from tests.oracle import assert_same, connect

Q, SQL = registry.queries(), registry.oracle_sql()
BOOKS = {"A": "OT", "B": "OT", "C": "NT", "D": None, "E": None}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """1,250 verses of eight words of a hundred in five books of three layers (one is null), some with repeated words, missing forms, copies, or more than 300 words."""
    d, rnd = str(tmp_path_factory.mktemp("parallels")), random.Random(9)
    verses, tokens = [], []
    for k, book in enumerate(BOOKS):
        for v in range(250):
            i = k * 1000 + v
            verses.append((i, book, 1 + v // 25, v % 25 + 1, "x", "t", "w", "p"))
            roots = [rnd.randrange(100) for _ in range(rnd.choice((2, 8, 8, 8)))] if v else [rnd.randrange(100, 9000) for _ in range(150)] + list(range(100, 300))
            tokens += [(i, p, f"W{r}ing" if r % 9 else None, "l", f"H{r}", "H", "N", r == 50) for p, r in enumerate(roots)]
    tokens += tokens[:100]
    spark.createDataFrame(verses, "verse_id long, book string, chapter int, verse int, language string, text string, word_string string, phrase_string string").write.parquet(f"{d}/verses.parquet")
    spark.createDataFrame(tokens, "verse_id long, position int, surface string, lemma string, root string, strongs string, morph string, is_stop boolean").write.parquet(f"{d}/tokens.parquet")
    spark.createDataFrame([(n, b, layer, "g") for n, (b, layer) in enumerate(BOOKS.items()) if b != "E"], "book_num int, name string, testament string, baseline_group string").write.parquet(f"{d}/books.parquet")
    return d, len(tokens)


def _shuffled(spark) -> dict[int, int]:
    """Rows written to shuffles by each stage so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_equals_sql_and_shuffles_no_pairs(spark, corpus):
    d, n_tokens = corpus
    before = _shuffled(spark)
    rows = Q["parallels"](spark, d).collect()
    sent = sum(n for k, n in _shuffled(spark).items() if k not in before)
    assert len(rows) > 1000 and {BOOKS[r["book_a"]] == BOOKS[r["book_b"]] for r in rows} == {True, False}
    assert max(r["common"] for r in rows) >= 200
    assert sent < 6 * n_tokens
    assert_same(Q["parallels"](spark, d), connect(d), SQL["parallels"])


@pytest.mark.parametrize("block, pairs, least", [(65_536, 1 << 17, 3), (70, 50, 3), (64, 5, 4), (128, 1000, 1)])
def test_blocks_do_not_matter(monkeypatch, block, pairs, least):
    """Against every pair of rows: blocks, batches and the number of units asked for, with units set aside."""
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "PAIRS", pairs)
    monkeypatch.setattr(P, "ROUND", 7)
    monkeypatch.setattr(P, "CACHE", 64)
    rnd = random.Random(block)
    rows = [(i, rnd.choice("ABCD"), rnd.choice(("OT", "NT", None)), *([rnd.randrange(25) for _ in range(n)] for n in [rnd.randint(1, 9)] * 2)) for i in range(300)]
    skip = [("root", "A", 3), ("root", "A", 99), ("stem", "B", 5), ("root", "Z", 1), ("root", "D", 0)]
    table = lambda x: pa.table({c: pa.array(v, t) for c, v, t in zip(("verse_id", "book", "layer", "root", "stem"), zip(*x), (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())))})
    aside = pa.array([{"kind": k, "book": b, "unit": u} for k, b, u in skip], pa.struct([("kind", pa.string()), ("book", pa.string()), ("unit", pa.int32())]))
    got = [tuple(r.values()) for b in P._pairs(table(rows[:140]), table(rows[140:]), aside, least, 0.5) for r in b.to_pylist()]
    want = []
    for a, b in permutations(rows, 2):
        kind = 3 if a[2] == b[2] else 4
        x, y = ([u for u in r[kind] if (("root", "stem")[kind - 3], a[1], u) not in skip] for r in (a, b))
        common = lcs_length(x, y)
        if a[0] < 140 <= b[0] and a[1] != b[1] and len(set(x) & set(y)) >= least and common >= least and common / min(len(x), len(y)) >= 0.5:
            want.append((a[0], a[1], b[0], b[1], common, common / min(len(x), len(y))))
    assert sorted(got) == sorted(want) and len(want) > 5
    assert not list(P._pairs(table(rows[:140]), table(rows[140:]).slice(0, 0), aside, least, 0.5))
