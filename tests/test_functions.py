"""Measures, text functions and sequence functions on known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmark.functions import measures as M, sequences as Q, text as T
from quillmark.operators import style as Y, strips as H


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()
    return row.asDict()


@pytest.mark.parametrize("a,b,n1,n2,want", [(10, 5, 1000, 10000, 29.8156), (1, 50, 1000, 10000, -4.4829), (5, 0, 1000, 9000, 23.0259), (0, 20, 1000, 10000, -3.8124), (2, 20, 1000, 10000, 0.0), (3, 3, 0, 10, 0.0)])
def test_log_likelihood(spark, a, b, n1, n2, want):
    assert one(spark, x=M.g2(F.lit(a), F.lit(b), F.lit(n1), F.lit(n2)))["x"] == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("k,e,n,want", [(20, 5, 1000, 25.6791), (2, 10, 100, -10.2532), (5, 5, 50, 0.0)])
def test_binomial_log_likelihood(spark, k, e, n, want):
    assert one(spark, x=M.g2_binomial(F.lit(k), F.lit(e), F.lit(n)))["x"] == pytest.approx(want, abs=1e-4)


def test_other_measures(spark):
    r = one(
        spark, lift=M.lift(F.lit(10), F.lit(2.5)), rarity=M.rarity(F.lit(1), F.lit(2000)), none=M.per_thousand(F.lit(3), F.lit(0)), some=M.per_thousand(F.lit(1), F.lit(3)),
        low=M.occurrence_floor(F.lit(100)), mid=M.occurrence_floor(F.lit(6000)), even=M.occurrence_floor(F.lit(6750)), high=M.occurrence_floor(F.lit(10**6)), rank=M.mid_rank(F.lit(3), F.lit(2), F.lit(8)),
    )
    assert r["lift"] == pytest.approx(2.6667, abs=1e-4) and r["rarity"] == pytest.approx(7.6009, abs=1e-4)
    assert (r["none"], r["some"], r["low"], r["mid"], r["even"], r["high"], r["rank"]) == (0.0, 333.33, 3, 4, 4, 5, 0.5)


def test_vector_measures(spark):
    df = spark.createDataFrame([([0.5, 0.5], [1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(M.hellinger("a", "b").alias("h"), M.cosine("a", "b").alias("c"), M.cosine("a", "z").alias("z")).first()
    assert r["h"] == pytest.approx(math.sqrt(((math.sqrt(0.5) - 1) ** 2 + 0.5) / 2)) and r["c"] == pytest.approx(math.sqrt(0.5)) and r["z"] == 0


def test_poisson_range():
    lo, hi = Y.poisson_range(10, 5.0)
    assert (lo, hi) == (pytest.approx(4.7954 / 5, abs=1e-3), pytest.approx(18.3904 / 5, abs=1e-3))
    assert Y.poisson_range(0, 2.0)[0] == 0 and Y.poisson_range(0, 2.0)[1] == pytest.approx(3.6889 / 2, abs=1e-3)
    assert Y.chi2_quantile(0.95, 1) == pytest.approx(3.8415, abs=1e-3)


def test_tokens(spark):
    df = spark.createDataFrame([("The LORD’s house—Beth–el 12 x_y, don't",), (None,), ("",), ("שָׁלוֹם λόγος",)], "t string")
    got = [r["w"] for r in df.select(T.tokenise("t").alias("w")).collect()]
    assert got == [["the", "lord's", "house-beth-el", "x", "y", "don't"], None, [], ["שָׁלוֹם", "λόγος"]]
    assert one(spark, x=T.tokenise(F.lit("GOD and LORD")))["x"] == ["GOD", "and", "LORD"]


def test_small_text_functions(spark):
    r = one(
        spark, fold=T.fold(F.lit("Beth-el's")), trim=T.trim_formula(F.lit("and for the day of the")), last=T.trim_formula(F.lit("the of")), num=T.simple_strongs(F.lit("~H0430G=x")), none=T.simple_strongs(F.lit("x")),
        gloss=T.clean_gloss(F.lit("to  see (a) [b] <i>well</i>;")), ok=T.is_numeric(F.lit("-1.5e3")), no=T.is_numeric(F.lit("1:5")), white=T.strip_colour(F.lit(1.0)), red=T.strip_colour(F.lit(9.0)), blue=T.strip_colour(F.lit(0.25)),
    )
    assert (r["fold"], r["trim"], r["last"], r["num"], r["none"]) == ("bethels", "the day", "the", "H430", None)
    assert (r["gloss"], r["ok"], r["no"]) == ("to see well", True, False)
    assert (r["white"], r["red"], r["blue"]) == ("#ffffff", "#ff0000", "#0000ff")


def test_references(spark):
    cases = {"1Vor 5.3": ("1Vor", 5, 3, 3), "Sgt. 53:26–28": ("Sgt", 53, 26, 28), "Acts of the Heralds 17:15-21": ("Acts of the Heralds", 17, 15, 21), "nothing": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.reference("t").alias("r"))
    assert {r["t"]: tuple(r["r"]) if r["r"] else None for r in df.collect()} == cases


def test_morphology(spark):
    hebrew = {"HVqi3mp": ("imperfect", 3, "masculine", "plural"), "HNcfsc": (None, None, "feminine", "singular"), "HAamsa": (None, None, "masculine", "singular"), "HNp": (None, None, None, None), "HR": (None, None, None, None)}
    for code, want in hebrew.items():
        assert tuple(one(spark, x=T.hebrew_morph(F.lit(code)))["x"]) == want
    greek = {"V-AAI-3S": ("aorist", "active", "indicative", 3, None, "singular"), "V-PAP-NSM": ("present", "active", "participle", None, "masculine", "singular"), "N-GSF": (None, None, None, None, "feminine", "singular"), "CONJ": (None,) * 6}
    for code, want in greek.items():
        assert tuple(one(spark, x=T.greek_morph(F.lit(code)))["x"]) == want
    parts = {"HVqi3mp": "verb", "HR": "preposition", "HC": "conjunction", "N-GSF": "noun", "T-NSM": "article", "PREP": "preposition", "CONJ": "conjunction", "A-ASN": "adjective"}
    assert {k: one(spark, x=T.part_of_speech(F.lit(k)))["x"] for k in parts} == parts


def test_stems(spark):
    known = frozenset({"profane", "move", "walk"})
    cases = {"cometh": "come", "came": "come", "saith": "say", "cities": "city", "pastures": "pasture", "churches": "church", "sitting": "sit", "profaned": "profane", "moved": "move", "walked": "walk", "walking": "walk", "lord's": "lord", "darkness": "darkness", "this": "this", "sings": "sing"}
    assert {w: T.stem(w, known | {"come"}) for w in cases} == cases
    df = spark.createDataFrame([(w,) for w in [*cases, None]], "w string")
    assert {r[0]: r[1] for r in df.select("w", T.stems(F.col("w"), known | {"come"})).collect()} == cases | {None: None}


IRREGULAR_CASES = ("made", "knew", "kept", "wolves", "died", "left", "priests", "dies", "thing", "glass", "boxes", "horses", "praised", "judged", "falling", "stopped", "")


def test_stems_with_a_joined_vocabulary(spark):
    """The vocabulary as a table gives what the plain function gives, whatever words there are."""
    rnd = random.Random(4)
    letters = [rnd.choice(["ab", "move", "profan", "sit", "stopp", "judg", "chur", "wal"]) + rnd.choice(["", "ch", "s", "k", "e", "v"]) + rnd.choice(["", "s", "es", "ed", "ing", "ings", "eth", "est", "ieth", "ies", "ied", "'s", "ous", "is"]) for _ in range(400)]
    words = [*letters, *IRREGULAR_CASES, "saith", None]
    known = frozenset(w for w in letters if rnd.random() < 0.3) | {"move", "profane"}
    df = spark.createDataFrame([(w, "clash") for w in words], "w string, stem_x string")
    got = {r["w"]: r["stem"] for r in T.stemmed(df, spark.createDataFrame([(w,) for w in [*known, None]], "word string"), "w").collect()}
    assert got == {w: None if w is None else T.stem(w, known) for w in words}
    assert T.stemmed(df.limit(0), df.select(F.col("w").alias("word")), "w").count() == 0


def test_irregular_forms():
    assert all(T.stem(w) == T.IRREGULAR[w] for w in T.IRREGULAR) and len(T.IRREGULAR) == 139
    assert {w: T.stem(w) for w in ("made", "knew", "kept", "wolves", "boxes", "stopped", "glass", "dies")} == {"made": "make", "knew": "know", "kept": "keep", "wolves": "wolf", "boxes": "box", "stopped": "stop", "glass": "glass", "dies": "die"}


def test_normal_forms():
    old = {"shew": "show", "publick": "public", "shewed": "showed"}
    assert [T.normal_form(w, old) for w in ("Shew", "shewed", "Lord's", "Beth-el", "publick")] == ["show", "show", "lord", "bethel", "public"]


def test_transliteration():
    assert T.greek_latin("λόγος") == "logos" and T.greek_latin("ἄγγελος") == "angelos" and T.greek_latin("ὕδωρ") == "hudor" and T.greek_latin("Χριστός") == "Christos"
    assert T.hebrew_latin("שָׁלוֹם") == "shalom" and T.hebrew_latin("דָּבָר") == "davar" and T.hebrew_latin("בֵּן") == "ben" and T.hebrew_latin("שִׂים") == "sim"
    assert T.bare("Λόγος, ὁ") == "λογοσ"
    assert T.greek_latin("ὕδωρ", True) == "hudōr" and T.greek_latin("ῥῆμα") == "rhema" and T.greek_latin("") == ""
    hebrew = {
        "תּוֹרָה": "tora", "בַּיִת": "bayit", "בְּרִית": "berit", "כֹּהֵן": "kohen", "רוּחַ": "ruakh", "חָכְמָה": "khokhma", "שַׁבָּת": "shabbat", "וָבֹהוּ": "vavohu", "גָּדוֹל": "gadol", "הַשָּׁמַיִם": "hashamayim",
        "וּמִן": "umin", "בֵּית־אֵל": "bet-el", "קֹדֶשׁ": "kodesh", "צִוָּה": "tsivva", "בָּאָרֶץ": "ba'arets", "חַיִּים": "khayyim", "": "",
    }
    assert {w: T.hebrew_latin(w) for w in hebrew} == hebrew
    assert T.hebrew_latin("צָבָא", True) == "tsāvā" and T.hebrew_latin("תֹהוּ", True) == "tōhū"


def test_packing(spark):
    fields = (("a", 16), ("b", 8), ("c", 20))
    df = spark.createDataFrame([(0, 0, 0), (65535, 255, 1048575), (7, 9, 11)], "a int, b int, c int")
    back = df.select("a", "b", "c", T.pack(*fields).alias("p")).select("a", "b", "c", *(x.alias(f"x_{n}") for x, (n, _) in zip(T.unpack(F.col("p"), *fields), fields)))
    assert all((r["a"], r["b"], r["c"]) == (r["x_a"], r["x_b"], r["x_c"]) for r in back.collect())


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_sequences_against_brute_force():
    rnd = random.Random(6)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        assert Q.lcs_length(a, b) == _lcs(a, b)
        runs = [k for k in range(len(a) + 1) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k]]
        assert Q.longest_common_run(a, b) == max(runs, default=0)
        assert Q.longest_common_run(a, b, 1) >= Q.longest_common_run(a, b)
        want = set(rnd.sample("abcde", 2))
        spans = [j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if want <= set(a[i:j])]
        assert Q.smallest_window(a, list(want)) == min(spans, default=0)
    assert Q.longest_common_run(list("abcXdef"), list("abcYdef"), 1) == 6 and Q.longest_common_run(list("abcdef"), list("abcZdef"), 1) == 6
    assert Q.without(list("abca"), frozenset("a")) == (["b", "c"], [1, 2])


def test_sequence_columns(spark):
    df = spark.createDataFrame([(list("abc"), list("axbc"))], "a array<string>, b array<string>")
    assert tuple(df.select(Q.lcs("a", "b"), Q.common_run("a", "b"), Q.bridged_run("a", "b"), Q.tightest_span("b", "a")).first()) == (3, 2, 3, 4)


def test_moving_variety():
    items = [random.Random(1).randint(0, 20) for _ in range(130)]
    brute = [len(set(items[i : i + 50])) / 50 for i in range(len(items) - 49)]
    assert H.moving_variety(items) == pytest.approx(sum(brute) / len(brute))
    assert H.moving_variety([1, 1, 2]) == pytest.approx(2 / 3) and H.moving_variety([]) == 0
