"""A book's manner: function words, set phrases, chapters akin, bands of heat, runs of one size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillmark.functions import measures as M, text as T
from quillmark.operators import corpus as C, similarity as S, strips as H
from quillmark.plans import style_queries as Y
from quillmark.plans.fact_queries import _T
from quillmark.plans.link_queries import _KN

R = M.rounded

# Features of the New Testament's manner, with the numbers they group.
GREEK_FEATURES = {
    "de": ("G1161",), "kai": ("G2532",), "gar": ("G1063",), "oun": ("G3767",), "alla": ("G235",), "ou": ("G3756",), "me": ("G3361",), "hoti": ("G3754",), "hina": ("G2443",), "ei": ("G1487",), "en": ("G1722",), "eis": ("G1519",),
    "ek": ("G1537",), "dia": ("G1223",), "kata": ("G2596",), "pros": ("G4314",), "autos": ("G846",), "hos": ("G3739",), "pas": ("G3956",), "I/me": ("G1473", "G3450", "G3427", "G3165", "G1691", "G1698", "G1700"),
    "we/us": ("G2249", "G2257", "G2254", "G2248"), "thou": ("G4771", "G4675", "G4671", "G4571"), "ye/you": ("G5210", "G5216", "G5213", "G5209"),
}
# Features of the Old Testament's manner.
HEBREW_FEATURES = {
    "wa-": ("H9001",), "we-": ("H9002",), "ha-": ("H9009",), "be-": ("H9003",), "le-": ("H9005",), "ke-": ("H9004",), "mi-": ("H9006",), "et": ("H853",), "ki": ("H3588",), "lo": ("H3808",), "al (not)": ("H408",), "asher": ("H834",),
    "al": ("H5921",), "el": ("H413",), "ad": ("H5704",), "im": ("H518",), "kol": ("H3605",), "gam": ("H1571",), "hinneh": ("H2009", "H2005"), "hu/hi": ("H1931",), "I": ("H589", "H595"), "thou": ("H859",), "we": ("H587", "H580"), "they": ("H1992", "H2007"),
    "-i/-nu": ("H9020", "H9030", "H9040", "H9025", "H9035", "H9045"), "-ka": ("H9021", "H9022", "H9031", "H9032", "H9041", "H9042", "H9026", "H9027", "H9036", "H9037", "H9046", "H9047"),
    "-o/-am": ("H9023", "H9024", "H9033", "H9034", "H9043", "H9044", "H9028", "H9029", "H9038", "H9039", "H9048", "H9049"),
}
# Phrases of time and place, with the wordings they group.
PHRASES = {
    "unto this day": ("unto this day", "to this day"), "in that day": ("in that day",), "in those days": ("in those days",), "latter days": ("latter days", "last days", "latter end"), "day of the LORD": ("day of the lord",),
    "God of heaven": ("god of heaven", "lord of heaven", "king of heaven"), "beyond the river": ("beyond the river", "this side the river", "other side of the river", "other side the river", "other side of the flood"),
    "this side Jordan": ("this side jordan", "on this side jordan", "beyond jordan", "other side jordan", "other side of jordan"),
}
#: Bands of heat: the square roots of good and of strong evidence.
WARM, HOT = math.sqrt(3.84), math.sqrt(10.83)


def _features() -> Column:
    return F.create_map(*(F.lit(x) for table in (GREEK_FEATURES, HEBREW_FEATURES) for name, numbers in table.items() for n in numbers for x in (n, name)))


def _by_feature(spark: SparkSession, d: str, by: list[str], place: Column | None = None) -> DataFrame:
    """(by, feature, uses, rate): uses per thousand words of each feature, where there are any."""
    t = C.tokens(spark, d)
    t = t.withColumn(by[-1], place) if place is not None else t
    t = t.select(*by, F.element_at(_features(), T.simple_strongs("strongs")).alias("feature"))
    n = t.groupBy(*by, "feature").agg(F.count("*").alias("n"))
    size = n.groupBy(*by).agg(F.sum("n").alias("words"))
    return n.where("feature is not null").join(size, by).select(*by, "feature", F.col("n").alias("uses"), M.per_thousand("n", "words").alias("rate"))


def feature_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the features of manner in each book, Greek and Hebrew by their numbers."""
    return _by_feature(spark, d, ["book"])


def feature_sections(spark: SparkSession, d: str) -> DataFrame:
    """The same in each ten chapters of a book."""
    return _by_feature(spark, d, ["book", "section"], F.floor((F.col("chapter") - 1) / 10).cast("int"))


def feature_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same in each ten verses of a book."""
    v = H.numbered(C.verses(spark, d).where("book is not null")).select("verse_id", F.floor(F.col("i") / 10).alias("tile"))
    t = C.tokens(spark, d).join(v, "verse_id").select("book", "tile", F.element_at(_features(), T.simple_strongs("strongs")).alias("feature"))
    n = t.groupBy("book", "tile", "feature").agg(F.count("*").alias("n"))
    size = n.groupBy("book", "tile").agg(F.sum("n").alias("words"))
    return n.where("feature is not null").join(size, ["book", "tile"]).select("book", "tile", "feature", F.col("n").alias("uses"), M.per_thousand("n", "words").alias("rate"))


def set_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Verses that hold one of the set phrases of time and place, with how often."""
    return phrase_uses(C.units(spark, d))


def phrase_uses(units: DataFrame) -> DataFrame:
    """(verse_id, phrase, uses) over the words of verses, wordings of one phrase together."""
    v = units.select("verse_id", F.concat(F.lit(" "), F.lower(F.array_join("words", " ")), F.lit(" ")).alias("s"))
    count = lambda w: (F.length("s") - F.length(F.replace(F.col("s"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)
    each = F.array(*(F.struct(F.lit(name).alias("phrase"), sum((count(w) for w in wordings[1:]), count(wordings[0])).cast("long").alias("uses")) for name, wordings in PHRASES.items()))
    return v.select("verse_id", F.explode(each).alias("x")).select("verse_id", "x.phrase", "x.uses").where("uses > 0")


def _kin_of_book(spark: SparkSession, d: str) -> DataFrame:
    v = C.verses(spark, d).select("verse_id", "book", "chapter")
    k = S.kin(C.tokens(spark, d), C.books(spark, d)).select("verse_a", "verse_b", "score", F.array_sort("order_a").alias("words"))
    k = k.join(v.toDF("verse_a", "book", "chapter_a"), "verse_a").join(v.toDF("verse_b", "bb", "chapter_b"), "verse_b").where("book = bb and chapter_a <> chapter_b")
    return k.select("book", "verse_a", "verse_b", F.least("chapter_a", "chapter_b").alias("low"), F.greatest("chapter_a", "chapter_b").alias("high"), "words", "score")


def kin_refrains(spark: SparkSession, d: str) -> DataFrame:
    """Sets of rare words that kin verses of three pairs of chapters or more share: a book's frame, the smallest sets alone."""
    sets = _kin_of_book(spark, d).groupBy("book", "words").agg(F.count_distinct("low", "high").alias("pairs")).where("pairs >= 3")
    other = sets.select("book", F.col("words").alias("inner"))
    nested = sets.join(other, "book").where((F.size("inner") < F.size("words")) & (F.size(F.array_except("inner", "words")) == 0)).select("book", "words").distinct()
    return sets.join(nested, ["book", "words"], "left_anti").select("book", F.array_join("words", " ").alias("words"), "pairs")


def kin_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of a book by the kin verses they share, those aside whose words hold a refrain."""
    k = _kin_of_book(spark, d)
    r = kin_refrains(spark, d).select("book", F.split("words", " ").alias("refrain"))
    framed = k.join(r, "book").where(F.size(F.array_except("refrain", "words")) == 0).select("verse_a", "verse_b").distinct()
    left = k.join(framed, ["verse_a", "verse_b"], "left_anti")
    return left.groupBy("book", F.col("low").alias("chapter_a"), F.col("high").alias("chapter_b")).agg(F.count("*").alias("kin"), R(F.sum("score"), 4).alias("score"))


def neighbour_verses(spark: SparkSession, d: str) -> DataFrame:
    """The verses before and after each verse in its book, across chapters, 0 where there is none; joined by place, so no book is sorted in one task."""
    v = H.numbered(C.verses(spark, d).where("book is not null")).select("book", "i", "verse_id")
    a = v.select("book", (F.col("i") + 1).alias("i"), F.col("verse_id").alias("before"))
    b = v.select("book", (F.col("i") - 1).alias("i"), F.col("verse_id").alias("after"))
    out = v.join(a, ["book", "i"], "left").join(b, ["book", "i"], "left")
    return out.select("verse_id", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def runs_of_size(spark: SparkSession, d: str) -> DataFrame:
    """For each book the runs of chapters of other books that are about its size: from each chapter on to four fifths of it, if that is no more than five quarters.

    The sizes before each chapter are one array for a book, so a run's end is looked up in it; a book's chapters bound it.
    """
    v = C.units(spark, d).groupBy("book", "chapter").agg(F.sum(F.size("words")).cast("long").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("book").orderBy("chapter"))
    c = v.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("w"))
    ends = c.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("upto", "chapter"))).alias("ends"), F.sum("w").alias("size"))
    own = ends.select(F.col("book").alias("of"), F.col("size").alias("n"))
    starts = c.join(ends.select("book", "ends"), "book").select("book", F.col("chapter").alias("first"), "before", "ends")
    pairs = starts.join(F.broadcast(own), F.col("of") != F.col("book"))  # one row for each book, a reference list
    end = F.get(F.filter("ends", lambda e: (e["upto"] - F.col("before")) * 5 >= F.col("n") * 4), F.lit(0))
    out = pairs.select("of", "book", "first", end["chapter"].alias("last"), (end["upto"] - F.col("before")).alias("words"), "n")
    return out.where(F.col("words") * 4 <= F.col("n") * 5).select("of", "book", "first", "last", "words")


def heat_bands(spark: SparkSession, d: str) -> DataFrame:
    """Hot, warm and cool spots: strong evidence, good evidence clear of any hot spot, strong evidence of little."""
    z = Y.strip_g2(spark, d)
    return H.bands(z, WARM, HOT).withColumn("peak", R(F.col("peak"), 5))


def isolated_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of windows whose share of rare words is among the highest twentieth, joined where they share half a window."""
    p = Y.strip_percentile(spark, d).where("measure = 'rare' and percentile >= 0.95").select("book", "start", "measure", F.col("percentile").alias("z"))
    return H.spots(p, 0.95).select("book", "first", "last", "windows", "peak_start", "peak")


QUERIES = {f.__name__: f for f in (feature_rates, feature_sections, feature_windows, set_phrases, kin_refrains, kin_chapters, neighbour_verses, runs_of_size, heat_bands, isolated_passages)}

_FM = ", ".join(f"('{n}', '{name}')" for t in (GREEK_FEATURES, HEBREW_FEATURES) for name, ns in t.items() for n in ns)
_FE = f"""{_T}, fm(number, feature) AS (VALUES {_FM}), nv AS (SELECT verse_id, (row_number() OVER (PARTITION BY book ORDER BY chapter, verse, verse_id) - 1) // 10 AS tile FROM vb WHERE book IS NOT NULL),
ft AS (SELECT tk.book, ((chapter - 1) // 10)::INT AS section, tile, feature FROM tk JOIN nv USING (verse_id) LEFT JOIN fm ON number = regexp_replace(regexp_extract(strongs, '([HG]\\d+)', 1), '^([HG])0+(\\d)', '\\1\\2'))
"""


def _rates(by: str) -> str:
    keys = ", ".join(f"n.{k}" for k in by.split(", "))
    on = " AND ".join(f"n.{k} = z.{k}" for k in by.split(", "))
    return f"{_FE} SELECT {keys}, feature, uses, round(1000 * uses / words::DOUBLE, 2) AS rate FROM (SELECT {by}, feature, count(*) AS uses FROM ft WHERE feature IS NOT NULL GROUP BY ALL) n JOIN (SELECT {by}, count(*) AS words FROM ft GROUP BY ALL) z ON {on}"


_PU = " UNION ALL ".join(f"SELECT verse_id, '{name}' AS phrase, {' + '.join(f'''len(string_split(s, ' {w} ')) - 1''' for w in ws)} AS uses FROM s" for name, ws in PHRASES.items())
_KR = f"""{_KN}, kb AS (SELECT a.book, verse_a, verse_b, least(a.chapter, b.chapter) AS low, greatest(a.chapter, b.chapter) AS high, list_sort(oa) AS words, score FROM kn JOIN vb a ON a.verse_id = verse_a JOIN vb b ON b.verse_id = verse_b WHERE a.book = b.book AND a.chapter <> b.chapter),
ks AS (SELECT book, words, count(*) AS pairs FROM (SELECT DISTINCT book, words, low, high FROM kb) GROUP BY 1, 2 HAVING count(*) >= 3),
kf AS (SELECT * FROM ks x WHERE NOT EXISTS (SELECT 1 FROM ks y WHERE y.book = x.book AND len(y.words) < len(x.words) AND list_has_all(x.words, y.words)))
"""
_SPOT = """{n}r AS (SELECT *, CASE WHEN lag(start) OVER w IS NULL OR start - lag(start) OVER w > 5 THEN 1 ELSE 0 END AS new FROM {src} WINDOW w AS (PARTITION BY book, measure ORDER BY start)),
{n}g AS (SELECT *, sum(new) OVER (PARTITION BY book, measure ORDER BY start) AS spot FROM {n}r),
{n} AS (SELECT book, measure, min(start) AS first, max(start) + 9 AS last, count(*) AS windows, arg_max(z, abs(z) * 1e6 - start / 1e6) AS peak, arg_max(start, abs(z) * 1e6 - start / 1e6) AS peak_start FROM {n}g GROUP BY book, measure, spot)
"""
_HB = f"""WITH g2 AS ({Y.SQL['strip_g2']}), h0 AS (SELECT * FROM g2 WHERE z >= {HOT}), c0 AS (SELECT * FROM g2 WHERE z <= -{HOT}), {_SPOT.format(n='hs', src='h0')}, {_SPOT.format(n='cs', src='c0')},
wr AS (SELECT *, start - row_number() OVER (PARTITION BY book, measure ORDER BY start) AS isl FROM g2 WHERE z >= {WARM}), wi AS (SELECT book, measure, isl, min(start) AS a, max(start) AS b, max(z) AS m FROM wr GROUP BY 1, 2, 3),
wk1 AS (SELECT * FROM wi WHERE m < {HOT} AND NOT EXISTS (SELECT 1 FROM h0 WHERE h0.book = wi.book AND h0.measure = wi.measure AND h0.start + 9 >= wi.a AND h0.start <= wi.b + 9)),
w0 AS (SELECT wr.book, wr.measure, wr.start, wr.z FROM wr JOIN wk1 USING (book, measure, isl)), {_SPOT.format(n='ws', src='w0')}
"""

SQL = {
    "feature_rates": _rates("book"), "feature_sections": _rates("book, section"), "feature_windows": _rates("book, tile"),
    "set_phrases": f"{_T}, s AS (SELECT verse_id, ' ' || lower(array_to_string(words, ' ')) || ' ' AS s FROM un) SELECT verse_id, phrase, uses FROM ({_PU}) WHERE uses > 0",
    "kin_refrains": f"{_KR} SELECT book, array_to_string(words, ' ') AS words, pairs FROM kf",
    "kin_chapters": f"{_KR} SELECT book, low AS chapter_a, high AS chapter_b, count(*) AS kin, round(sum(score), 4) + 0.0 AS score FROM kb WHERE NOT EXISTS (SELECT 1 FROM kf WHERE kf.book = kb.book AND list_has_all(kb.words, kf.words)) GROUP BY 1, 2, 3",
    "neighbour_verses": f"{_T} SELECT verse_id, coalesce(lag(verse_id) OVER w, 0) AS before, coalesce(lead(verse_id) OVER w, 0) AS after FROM vb WHERE book IS NOT NULL WINDOW w AS (PARTITION BY book ORDER BY chapter, verse, verse_id)",
    "runs_of_size": f"""{_T}, v AS (SELECT book, chapter, sum(len(words))::BIGINT AS w FROM un GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY book ORDER BY chapter) AS upto FROM v), n AS (SELECT book AS of, sum(w) AS n FROM v GROUP BY 1),
      r AS (SELECT n.of, a.book, a.chapter AS first, b.chapter AS last, (b.upto - a.upto + a.w)::BIGINT AS words, n FROM n JOIN c a ON a.book <> n.of JOIN c b ON b.book = a.book AND b.chapter >= a.chapter AND (b.upto - a.upto + a.w) * 5 >= n * 4)
      SELECT of, book, first, last, words FROM (SELECT *, row_number() OVER (PARTITION BY of, book, first ORDER BY last) AS k FROM r) WHERE k = 1 AND words * 4 <= n * 5""",
    "heat_bands": f"""{_HB} SELECT book, measure, band, first, last, windows, peak_start, round(peak, 5) + 0.0 AS peak FROM (SELECT *, 'hot' AS band FROM hs UNION ALL SELECT *, 'warm' FROM ws UNION ALL SELECT *, 'cool' FROM cs)""",
    "isolated_passages": f"""WITH p AS (SELECT book, measure, start, percentile AS z FROM ({Y.SQL['strip_percentile']}) WHERE measure = 'rare' AND percentile >= 0.95), {_SPOT.format(n='sp0', src='p')} SELECT book, first, last, windows, peak_start, round(peak, 6) AS peak FROM sp0""",
}
