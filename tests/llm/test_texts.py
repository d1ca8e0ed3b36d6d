"""Tokenizer, containers, spans, one form and garbled text against reference encoders, round trips and brute force."""

import random
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from quillmark.llm.bpe import TOKENIZERS, SpeculativeBPE, encode
from quillmark.llm.lookalike import Lattice, bigram_counts, lookalike_pairs, one_form, plain
from quillmark.llm.mojibake import find_garbled
from quillmark.llm.packing import CapacityTree, best_fit_decreasing, cut_pieces, fill_containers
from quillmark.llm.spans import Chunking, shared_share, shared_windows

TEXTS = ["", "a", "Hello's world  \n\n x", " ", "\t\n ", "<|endoftext|>", "é" * 700, "ab" * 900, "!" * 500, "שִׂלֶצג ρώξελιξυ", "👩‍👧 光 ＡＢ", "we'll we’ll 12345 3.14"]


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def bpe():
    return SpeculativeBPE(f"{TOKENIZERS}/byte_bpe_50k.json")


def test_encoding_equals_exact_merging(bpe, exact):
    rnd = random.Random(7)
    pool = [chr(c) for c in [*range(0x250), *range(0x370, 0x600), *range(0x2000, 0x2070), 0x3000, 0x1F469]]
    texts = TEXTS + ["".join(rnd.choice(pool) if rnd.random() < 0.4 else rnd.choice("etaoin shr'd\n") for _ in range(rnd.randint(0, 120))) for _ in range(400)]
    assert bpe.encode(texts) == [exact(t) for t in texts]
    assert bpe.mended > 0


def test_encode_column(spark, exact):
    df = spark.createDataFrame([*enumerate(TEXTS), (90, None), (91, "a"), (91, "a")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as key")
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in encode(df, "doc_id", "text").collect())
    assert got == Counter([(i, tuple(exact(t))) for i, t in enumerate(TEXTS)] + [(90, ()), (91, tuple(exact("a"))), (91, tuple(exact("a")))])
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def _one_by_one(sizes, capacity):
    left = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(left) if r >= s]
        if fit:
            left[min(fit, key=lambda i: left[i])] -= s
        else:
            left.append(capacity - s)
    return Counter(left)


def test_runs_equal_best_fit_of_single_items():
    rnd = random.Random(1)
    for trial in range(60):
        capacity = rnd.choice([10, 37, 100])
        sizes = [min(capacity, max(1, int(rnd.paretovariate(0.8)))) if trial % 2 else rnd.randint(1, capacity) for _ in range(rnd.randint(0, 300))]
        plan = best_fit_decreasing(Counter(sizes), capacity)
        load, seen = Counter(), Counter()
        for s, a, b, f, per in zip(plan.size, plan.start, plan.end, plan.first_bin, plan.per):
            seen[s] += b - a
            for r in range(a, b):
                load[f + (r - a) // per] += s
        assert seen == Counter(sizes) and len(load) == plan.bins
        assert Counter(capacity - x for x in load.values()) == _one_by_one(sizes, capacity)


def test_capacity_tree():
    t = CapacityTree(20)
    for at in (3, 9, 20):
        t.set(at, True)
    assert [t.tightest(n) for n in (1, 3, 4, 10, 20)] == [3, 3, 9, 20, 20]
    t.set(20, False)
    assert t.tightest(10) is None


def test_pieces_join_to_the_text(bpe):
    for text in ["word " * 300, "x\n\n\n  y " * 100, "é" * 900, "ab" * 700 + " end", "one two"]:
        pieces = cut_pieces(bpe, text, 64)
        assert "".join(text[a:b] for a, b, _ in pieces) == text
        assert all(n == bpe.count(text[a:b]) <= 64 for a, b, n in pieces)


def test_containers_hold_everything(spark, exact):
    rnd = random.Random(4)
    texts = {i: " ".join(rnd.choice(["alpha", "beta", "גמל", "δέλτα", "\n"]) for _ in range(rnd.choice([0, 3, 20, 90]))) for i in range(120)} | {500: "", 501: None, 502: "z" * 400}
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, container string").repartition(3)
    rows = fill_containers(df, "doc_id", "text", capacity=64).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["start"], r["piece"], r["container"]))
    assert set(got) == set(texts)
    load = Counter()
    for i, pieces in got.items():
        assert (texts[i] is None and pieces[0][1] is None) or "".join(p for _, p, _ in sorted(pieces)) == texts[i]
        if texts[i] and len(exact(texts[i])) <= 64:
            assert len(pieces) == 1
        for _, p, c in pieces:
            load[c] += len(exact(p)) if p else 0
    assert max(load.values()) <= 64 and sum(load.values()) / (64 * len(load)) > 0.9
    assert fill_containers(df.limit(0), "doc_id", "text").count() == 0
    assert {r["container"] for r in fill_containers(df.where("doc_id in (500, 501)"), "doc_id", "text").collect()} == {0}


@pytest.mark.parametrize("chunking", [Chunking(span=30, reach=4, bits=2, gap=5, least=14), Chunking(span=12, reach=1, bits=1, gap=2, least=8)])
def test_spans_against_brute_force(spark, chunking):
    rnd = random.Random(9)
    span, texts = chunking.span, {}
    pools = [["".join(rnd.choice("abcde ") for _ in range(60)) for _ in range(6)], ["a" * 80, "ab" * 40, "ééé x" * 20]]
    for i in range(90):
        t = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 80)))
        if rnd.random() < 0.5:
            p = rnd.choice(rnd.choice(pools))
            lo = rnd.randint(0, 20)
            t += p[lo : lo + rnd.randint(span - 3, span + 9)] + "".join(rnd.choice("xyz") for _ in range(5))
        texts[i] = t
    rows = [(i, t, "clash") for i, t in texts.items()] + [(3, texts[3], "copy"), (700, None, ""), (701, "", ""), (None, "q" * 200, "")]
    df = spark.createDataFrame(rows, "id long, text string, at string")
    where = defaultdict(set)
    for i, t in texts.items():
        for k in range(len(t) - span + 1):
            where[t[k : k + span]].add((i, k))
    want = {x for s in where.values() if len({i for i, _ in s}) > 1 for x in s}
    assert {(r["id"], r["at"]) for r in shared_windows(df, "id", "text", chunking=chunking).collect()} == want and len(want) > 30
    covered = defaultdict(set)
    for i, k in want:
        covered[i] |= set(range(k, k + span))
    assert {r["id"]: (r["shared"], r["length"]) for r in shared_share(df, "id", "text", chunking=chunking).collect()} == {i: (len(c), len(texts[i])) for i, c in covered.items()}


def test_unit_spans_and_empty(spark):
    run = " ".join(f"u{i}" for i in range(12))
    df = spark.createDataFrame([(1, f" a {run} b "), (2, f" {run} "), (3, run.replace("u5", "v")), (4, f" {run} {run} ")], "id long, text string")
    assert {r["id"] for r in shared_windows(df, "id", "text", units=True).collect()} == {1, 2, 4}
    assert shared_windows(df.limit(0), "id", "text").count() == 0
    alone = spark.createDataFrame([(1, "x" * 300)], "id long, text string")
    assert shared_windows(alone, "id", "text").count() == 0


def test_one_form():
    f = Lattice({}).form
    assert f("Тhe plаnter　rοse") == f("The planter rose") == f("Ｔｈｅ planter rose") == f("The plan­ter r​ose") == "The planter rose"
    assert f("Liο̄n") == f("Liōn") == f("Lion̄".replace("n̄", "") + "ōn") or f("Liο̄n") == f("Liōn")
    assert f("ﬆone ﬁn") == "stone fin" and f("ατoµής") == f("ατομής") == "ατομής" and f("שׁ") == f("שׁ")
    for a, b in (("lion", "Lion"), ("lion", "lìon"), ("שֵׂ", "שַׂ"), ("rose", "rosa"), ("x²", "x2"), ("a  b", "a b")):
        assert f(a) != f(b)
    assert f("") == "" and plain("a\tb") == "a b"
    long = "ｔｈе " * 20000
    assert f(long) == "the " * 20000
    assert f("ｔｈе" * 100000) == "the" * 100000  # one word without a blank


def test_form_column_and_pairs(spark):
    rows = [("x", "1", "the rοse", 0), ("x", "2", "the rose", 0), ("x", "2", "the rose", 1), ("x", "3", "the rose", 0), ("x", "4", "The rose", 0), ("y", "5", "the rοse", 0), ("x", None, "the rοse", 0), ("x", "6", None, 0), ("x", "7", "", 0), ("x", "10", "the rοse", 0)]
    df = spark.createDataFrame(rows, "field_name string, key string, text string, form_id int")
    counts = bigram_counts(df, "text")
    assert sum(counts.values()) > 0
    forms = one_form(df, "text", counts)
    assert {r["form"] for r in forms.where("key = '6'").collect()} == {None}
    got = {(r["key_a"], r["key_b"]) for r in lookalike_pairs(forms).collect()}
    assert got == {("1", "2"), ("1", "3"), ("10", "2"), ("10", "3")}
    assert lookalike_pairs(forms.limit(0)).count() == 0


CLEAN = ["The café group’s résumé — naïve, déjà “vu”.", "Der Weg ist schön und größer als Füße.", "και το θέμα της αρχής είναι εδώ", "что было то было и это так же", "┌────┬───┐\n│ a  │ 1 │\n└────┴───┘", "© √2 ½ ± ™ €5 IRMÃ, GRÂCE, MAÇÃO « de »", "plain words", "[NOTE] &amp; {x: 1}"]


def test_garbled_texts_are_found_and_restored(spark):
    text = CLEAN[0]
    bad = {
        100: text.encode().decode("cp1252", "replace").replace("�", "\x9d"), 101: text.encode().decode("latin-1"), 102: text.encode().decode("cp437"), 103: text.encode().decode("mac_roman"),
        104: text.encode().decode("latin-1").encode().decode("latin-1"), 105: "clean start " + CLEAN[2].encode("cp1253").decode("latin-1") + " " + CLEAN[2].encode("cp1253").decode("latin-1"),
        106: CLEAN[3].encode().decode("cp1251", "replace") if "�" not in CLEAN[3].encode().decode("cp1251", "replace") else "вЂњword", 107: "lost � here",
    }
    base = [(k * 1000 + i, t, "clash") for k in range(1, 40) for i, t in enumerate(CLEAN)]
    base += [(200_000 + k, " ".join(f"x{chr(c)}y" for c in range(0xC0, 0x100)), "") for k in range(3000)]  # each of these letters is common by itself
    rows = base + [(i, t, "") for i, t in bad.items()] + [(1, None, ""), (2, "", ""), (3, "a" * 50000, "")]
    got = {r["doc_id"]: r for r in find_garbled(spark.createDataFrame(rows, "doc_id long, text string, restored string"), "doc_id", "text").collect()}
    assert set(got) == set(bad)
    for i in (100, 101, 102, 103, 104):
        assert got[i]["restored"] == text and got[i]["whole"]
    assert got[105]["restored"].endswith(CLEAN[2]) and not got[107]["whole"]


def test_garbled_empty(spark):
    assert find_garbled(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_slices_hold_every_row_once():
    import pyarrow as pa

    from quillmark.llm.rows import slices

    texts = ["a" * n for n in (0, 5, 5, 50, 1, 1, 1)] + [None, "é" * 30]
    batch = pa.RecordBatch.from_pydict({"k": list(range(9)), "t": pa.array(texts, pa.string())})
    for rows, size in ((2, 1000), (100, 8), (100, 1), (3, 20)):
        parts = list(slices(batch, 1, rows, size))
        assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(9)) and all(p.num_rows <= rows for p in parts)
    assert list(slices(batch.slice(0, 0), 1)) == []


def test_one_very_long_text(spark, exact):
    long = "the planter rose — élan 光 " * 20000
    df = spark.createDataFrame([(1, long), (2, "x" + long), (3, "short")], "doc_id long, text string")
    ids = {r["doc_id"]: r["ids"] for r in encode(df, "doc_id", "text").collect()}
    assert ids[1] == exact(long)
    pieces = fill_containers(df, "doc_id", "text").where("doc_id = 1").orderBy("start").collect()
    assert "".join(p["piece"] for p in pieces) == long and all(p["size"] <= 2048 for p in pieces)
    assert {r["id"] for r in shared_windows(df, "doc_id", "text").select("id").distinct().collect()} == {1, 2}
    assert find_garbled(df, "doc_id", "text").count() == 0
