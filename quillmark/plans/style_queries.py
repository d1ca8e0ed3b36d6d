"""Manner of the project's books: lift, Delta, richness, and strips along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillmark.functions import measures as M
from quillmark.operators import corpus as C, facts as X, links as L, similarity as S, strips as H, style as Y
from quillmark.plans import link_queries as K
from quillmark.plans.fact_queries import _CC, _FR, _RO, _T, _WB, chapter_facts, word_book
from quillmark.plans.link_queries import _PV

R = M.rounded


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """All words of each book."""
    return C.tokens(spark, d).groupBy("book").agg(F.count("*").alias("own"))


def _books(spark: SparkSession, d: str) -> DataFrame:
    return X.book_counts(X.chapter_counts(C.content(spark, d)))


def phrase_weight(spark: SparkSession, d: str) -> DataFrame:
    """Rarity of an echo: the sum over its units that are content roots."""
    w = S.rarities(C.tokens(spark, d), C.books(spark, d)).select(F.col("root").alias("unit"), "rarity")
    e = X.echoes(X.formula_facts(X.formulas(C.units(spark, d)))).select("phrase", F.explode(F.split("phrase", " ")).alias("unit"))
    return e.join(w, "unit", "left").groupBy("phrase").agg(R(F.sum(F.coalesce("rarity", F.lit(0.0)))).alias("weight"))


def concentration(spark: SparkSession, d: str) -> DataFrame:
    """Share of a book's 25 highest keyness values that its first three hold."""
    t = X.top_k(word_book(spark, d).where("keyness > 0"), ["book"], [F.desc("keyness"), F.col("root")], 25)
    return t.groupBy("book").agg(R(F.sum(F.when(F.col("rank") <= 3, F.col("keyness")).otherwise(0.0)) / F.sum("keyness")).alias("top_three"))


def local_rendering(spark: SparkSession, d: str) -> DataFrame:
    """The commonest form of a root in a book, where the book has at least half of that form's uses and it is under half of the root's."""
    c = C.content(spark, d).where("surface is not null")
    here = X.commonest(c, ["book", "root"], "surface").where("uses >= 3")
    form = c.groupBy("root", "surface").agg(F.count("*").alias("form_uses"))
    root = c.groupBy("root").agg(F.count("*").alias("root_uses"))
    out = here.join(form, ["root", "surface"]).join(root, "root")
    return out.where("uses * 2 >= form_uses and form_uses * 2 < root_uses").select("book", "root", "surface", "uses", "form_uses", "root_uses")


def group_keyness(spark: SparkSession, d: str) -> DataFrame:
    """Keyness of a root against the other books of the same group, from 6.63 on."""
    b = _books(spark, d).join(C.books(spark, d).where("baseline_group is not null"), "book")
    own = _sizes(spark, d)
    group = own.join(C.books(spark, d), "book").groupBy("baseline_group").agg(F.sum("own").alias("group_total"))
    root = b.groupBy("baseline_group", "root").agg(F.sum("weight").alias("group_root"))
    out = b.join(own, "book").join(group, "baseline_group").join(root, ["baseline_group", "root"])
    out = out.withColumn("keyness", R(M.g2("weight", F.col("group_root") - F.col("weight"), "own", F.col("group_total") - F.col("own"))))
    return out.where("keyness >= 6.63").select("book", "root", "weight", "keyness")


def book_lift(spark: SparkSession, d: str) -> DataFrame:
    return Y.book_lift(_books(spark, d), C.books(spark, d), _sizes(spark, d)).select("book", "root", "observed", R(F.col("expected")).alias("expected"), R(F.col("lift")).alias("lift"))


def _passage_counts(spark: SparkSession, d: str) -> DataFrame:
    p = K.passage_words(spark, d)
    w = C.content(spark, d).groupBy("root").agg(F.count("*").alias("w"))
    t = C.tokens(spark, d).join(C.books(spark, d).select("book", "testament"), "book", "left").groupBy("verse_id", F.coalesce("testament", F.lit("")).alias("t")).agg(F.count("*").alias("k"))
    parts = lambda c: [F.sum(c).alias("all"), F.sum(F.when(F.col("t") == "OT", F.col(c)).otherwise(0)).alias("ot"), F.sum(F.when(F.col("t") == "NT", F.col(c)).otherwise(0)).alias("nt")]
    size = K.passage_verses(spark, d).join(t, "verse_id").groupBy("passage_id").agg(*parts("k"))
    every = t.groupBy("t").agg(F.sum("k").alias("k")).agg(F.struct(*parts("k"))).scalar()
    of = lambda x: F.when(F.col("root").rlike(r"^H\d+$"), F.col(f"{x}ot")).when(F.col("root").rlike(r"^G\d+$"), F.col(f"{x}nt")).otherwise(F.col(f"{x}all"))
    x = p.join(w, "root").join(size, "passage_id").withColumn("e", every).withColumns({"size": of(""), "every": of("e.")})
    return x.where("size > 0 and every > size").select("passage_id", "root", "n", "w", "size", "every")


def passage_lift(spark: SparkSession, d: str) -> DataFrame:
    """Roots of each passage against the rest of the text: lift and keyness."""
    x = _passage_counts(spark, d)
    expected = (F.col("w") - F.col("n")) * F.col("size") / (F.col("every") - F.col("size"))
    return x.select("passage_id", "root", "n", R(M.lift("n", expected)).alias("lift"), R(M.g2("n", F.col("w") - F.col("n"), "size", F.col("every") - F.col("size"))).alias("keyness"))


def passage_absence(spark: SparkSession, d: str) -> DataFrame:
    """Of the roots that mark the books a passage stands in, how many it uses."""
    key = word_book(spark, d).where("keyness >= 10.83").select("book", "root")
    v = C.verses(spark, d).select("verse_id", "book")
    p = K.passage_verses(spark, d).join(v, "verse_id").select("passage_id", "book").distinct()
    marks = p.join(key, "book").select("passage_id", "root").distinct()
    used = K.passage_words(spark, d).select("passage_id", "root", F.lit(1).alias("used"))
    return marks.join(used, ["passage_id", "root"], "left").groupBy("passage_id").agg(F.count("*").alias("marks"), F.count("used").alias("used"))


def compare_layers(spark: SparkSession, d: str) -> DataFrame:
    """Roots of the two testaments: lift of each against the other, and keyness."""
    b = _books(spark, d).join(C.books(spark, d), "book")
    c = b.groupBy("root").agg(F.sum(F.when(F.col("testament") == "OT", F.col("weight")).otherwise(0)).alias("a"), F.sum(F.when(F.col("testament") == "NT", F.col("weight")).otherwise(0)).alias("b"))
    n = _sizes(spark, d).join(C.books(spark, d), "book")
    of = lambda t: n.where(F.col("testament") == t).agg(F.sum("own")).scalar()
    c = c.withColumns({"na": of("OT"), "nb": of("NT")})
    out = c.select("root", "a", "b", R(M.lift("a", F.col("b") * F.col("na") / F.col("nb"))).alias("lift_a"), R(M.lift("b", F.col("a") * F.col("nb") / F.col("na"))).alias("lift_b"), R(M.g2("a", "b", "na", "nb")).alias("keyness"))
    return out.where("a + b > 0")


def leaning_words(spark: SparkSession, d: str) -> DataFrame:
    """Roots used at twice the rate or more in one testament, with at least five uses there."""
    return compare_layers(spark, d).where("lift_a >= 2 and a >= 5 or lift_b >= 2 and b >= 5").select("root", "a", "b", F.when(F.col("lift_a") >= 2, "OT").otherwise("NT").alias("leans"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return C.tokens(spark, d).where("surface is not null").groupBy("book", F.lower("surface").alias("word")).agg(F.count("*").alias("weight"))


def _z(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d)
    return Y.z_scores(Y.rates(w, Y.features(w)))


def delta(spark: SparkSession, d: str) -> DataFrame:
    return Y.delta(_z(spark, d)).withColumn("delta", R(F.col("delta")))


def nearest_books(spark: SparkSession, d: str) -> DataFrame:
    p = delta(spark, d)
    both = p.select(F.col("book_a").alias("book"), F.col("book_b").alias("near"), "delta").unionByName(p.select(F.col("book_b").alias("book"), F.col("book_a").alias("near"), "delta"))
    return X.top_k(both, ["book"], [F.col("delta"), F.col("near")], 5).select("book", "rank", "near", "delta")


def delta_yardstick(spark: SparkSession, d: str) -> DataFrame:
    return Y.yardstick(delta(spark, d), "delta")


def delta_detail(spark: SparkSession, d: str) -> DataFrame:
    """The five words that set each book furthest from the average."""
    z = _z(spark, d).select("book", "feature", R(F.col("z")).alias("z"))
    return X.top_k(z, ["book"], [F.desc(F.abs("z")), F.col("feature")], 5).select("book", "rank", "feature", "z")


def function_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rates per thousand of twelve function words, one column each."""
    w = _words(spark, d)
    size = w.groupBy("book").agg(F.sum("weight").alias("total"))
    names = ["the", "and", "of", "to", "in", "that", "he", "shall", "unto", "for", "his", "they"]
    p = w.groupBy("book").pivot("word", names).agg(F.sum("weight"))
    return p.join(size, "book").select("book", *(M.per_thousand(F.coalesce(F.col(c), F.lit(0)), "total").alias(f"w_{c}") for c in names))


def richness(spark: SparkSession, d: str) -> DataFrame:
    """Roots, roots used once here, roots of no other book, per book."""
    b = _books(spark, d)
    reach = b.groupBy("root").agg(F.count("*").alias("books"))
    out = b.join(reach, "root").groupBy("book").agg(F.sum("weight").alias("words"), F.count("*").alias("roots"), F.count_if(F.col("weight") == 1).alias("once"), F.count_if(F.col("books") == 1).alias("own"))
    return out.select("*", R(F.col("once") / F.col("roots")).alias("once_share"), M.per_thousand("own", "words").alias("own_per_thousand"))


def reach_depth(spark: SparkSession, d: str) -> DataFrame:
    """The 40 roots of highest keyness and the 20 of greatest depth of each book, together."""
    key = word_book(spark, d).where("keyness > 0")
    deep = X.depth(X.chapter_keyness(*chapter_facts(spark, d)), ["book", "root"])
    a = X.top_k(key, ["book"], [F.desc("keyness"), F.col("root")], 40).select("book", "root")
    b = X.top_k(deep, ["book"], [F.desc("depth"), F.col("root")], 20).select("book", "root")
    return a.unionByName(b).distinct()


def dice_books(spark: SparkSession, d: str) -> DataFrame:
    """Closeness of two books: twice what their word counts share over both sizes."""
    b = _books(spark, d).select("book", "root", "weight")
    size = b.groupBy("book").agg(F.sum("weight").alias("n"))
    x, y = b.select("root", F.col("book").alias("book_a"), F.col("weight").alias("wa")), b.select("root", F.col("book").alias("book_b"), F.col("weight").alias("wb"))
    both = x.join(y, "root").where("book_a < book_b").groupBy("book_a", "book_b").agg(F.sum(F.least("wa", "wb")).alias("both"))
    out = both.join(size.select(F.col("book").alias("book_a"), F.col("n").alias("na")), "book_a").join(size.select(F.col("book").alias("book_b"), F.col("n").alias("nb")), "book_b")
    return out.select("book_a", "book_b", R(2 * F.col("both") / (F.col("na") + F.col("nb"))).alias("closeness"))


def chapter_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Hellinger distance of the word mix of each chapter from the chapter before."""
    c = X.chapter_counts(C.content(spark, d)).select("book", "chapter", "root", "weight")
    n = c.groupBy("book", "chapter").agg(F.sum("weight").alias("n"))
    p = c.join(n, ["book", "chapter"]).select("book", "chapter", "root", (F.col("weight") / F.col("n")).alias("p"))
    q = p.select("book", (F.col("chapter") + 1).alias("chapter"), "root", F.col("p").alias("q"))
    both = p.join(q, ["book", "chapter", "root"]).groupBy("book", "chapter").agg(F.sum(F.sqrt(F.col("p") * F.col("q"))).alias("c"))
    pairs = n.select("book", "chapter").join(n.select("book", (F.col("chapter") + 1).alias("chapter")), ["book", "chapter"])
    return pairs.join(both, ["book", "chapter"], "left").select("book", "chapter", R(F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce("c", F.lit(0.0))))).alias("distance"))


def section_words(spark: SparkSession, d: str) -> DataFrame:
    """Leading roots of each ten chapters of a book against the rest of the book."""
    c = X.chapter_counts(C.content(spark, d)).withColumn("section", F.floor((F.col("chapter") - 1) / 10).cast("int"))
    s = c.groupBy("book", "section", "root").agg(F.sum("weight").alias("weight"))
    own = X.chapter_sizes(C.tokens(spark, d)).groupBy("book", F.floor((F.col("chapter") - 1) / 10).cast("int").alias("section")).agg(F.sum("words").alias("own"))
    book = own.groupBy("book").agg(F.sum("own").alias("total"))
    root = s.groupBy("book", "root").agg(F.sum("weight").alias("book_root"))
    out = s.join(own, ["book", "section"]).join(book, "book").join(root, ["book", "root"])
    out = out.withColumn("keyness", R(M.g2("weight", F.col("book_root") - F.col("weight"), "own", F.col("total") - F.col("own")))).where("keyness > 0")
    return X.top_k(out, ["book", "section"], [F.desc("keyness"), F.col("root")], 10).select("book", "section", "rank", "root", "weight", "keyness")


def halves(spark: SparkSession, d: str) -> DataFrame:
    """Words of the two halves of each book, cut at the verse where half of its words are reached."""
    v = C.units(spark, d).select("book", "chapter", "verse", "verse_id", F.size("words").cast("long").alias("w"))
    per = v.groupBy("book", "chapter").agg(F.sum("w").alias("cw"))
    before = F.coalesce(F.sum("cw").over(Window.partitionBy("book").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("before", before)
    total = v.groupBy("book").agg(F.sum("w").alias("total"))
    run = F.sum("w").over(Window.partitionBy("book", "chapter").orderBy("verse", "verse_id").rowsBetween(Window.unboundedPreceding, 0))
    out = v.withColumn("run", run).join(per.select("book", "chapter", "before"), ["book", "chapter"]).join(total, "book")
    half = F.when((F.col("run") + F.col("before") - F.col("w")) * 2 < F.col("total"), 1).otherwise(2)
    return out.groupBy("book", half.alias("half")).agg(F.count("*").alias("verses"), F.sum("w").alias("words"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    t = C.tokens(spark, d)
    return H.windows(H.verse_facts(C.verses(spark, d).where("book is not null"), t, S.rare_roots(t, C.books(spark, d))))


def strips(spark: SparkSession, d: str) -> DataFrame:
    return H.counted(_windows(spark, d)).withColumn("score", R(F.col("score")))


def strip_hammer(spark: SparkSession, d: str) -> DataFrame:
    return H.hammer(_windows(spark, d))


def strip_variety(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("book", "start", R(H.variety("roots")).alias("variety"))


def strip_z(spark: SparkSession, d: str) -> DataFrame:
    return H.z_scale(strips(spark, d)).select("book", "start", "measure", R(F.col("z"), 5).alias("z"))


def strip_percentile(spark: SparkSession, d: str) -> DataFrame:
    return H.percentile_scale(strips(spark, d)).select("book", "start", "measure", R(F.col("percentile")).alias("percentile"))


def strip_bell(spark: SparkSession, d: str) -> DataFrame:
    """The percentile scale as points of the bell curve."""
    return H.percentile_scale(strips(spark, d)).select("book", "start", "measure", R(H.normal_place("percentile")).alias("z"))


def strip_g2(spark: SparkSession, d: str) -> DataFrame:
    return H.g2_scale(strips(spark, d)).select("book", "start", "measure", R(F.col("z"), 5).alias("z"))


def spots(spark: SparkSession, d: str) -> DataFrame:
    return H.spots(strip_z(spark, d))


def chapter_strip(spark: SparkSession, d: str) -> DataFrame:
    """Mean z of the windows that begin in each chapter."""
    v = H.numbered(C.verses(spark, d).where("book is not null")).select("book", "chapter", F.col("i").alias("start"))
    return strip_z(spark, d).join(v, ["book", "start"]).groupBy("book", "chapter", "measure").agg(R(F.avg("z"), 4).alias("z"), F.count("*").alias("windows"))


_BL = f"""{_CC}, pb AS (SELECT b.book, p.book AS peer, b.baseline_group IS NOT NULL AND b.baseline_group = p.baseline_group AS own FROM bk b JOIN bk p ON b.testament = p.testament AND b.book <> p.book),
pn AS (SELECT *, sum(CASE WHEN coalesce(own, false) THEN 1 ELSE 0 END) OVER (PARTITION BY book) AS k FROM pb), pr AS (SELECT book, peer FROM pn WHERE coalesce(own, false) OR k < 2)
"""
_DL = f"""{_T}, w AS (SELECT book, lower(surface) AS word, count(*) AS weight FROM tk WHERE surface IS NOT NULL GROUP BY 1, 2),
f AS (SELECT word AS feature FROM w GROUP BY 1 HAVING count(*) >= ceil(0.5 * (SELECT count(DISTINCT book) FROM w)) ORDER BY sum(weight) DESC, word LIMIT 150),
z0 AS (SELECT book, sum(weight) AS total FROM w GROUP BY 1), rt AS (SELECT z0.book, feature, 1000 * coalesce(weight, 0) / total::DOUBLE AS rate FROM z0 CROSS JOIN f LEFT JOIN w ON w.book = z0.book AND w.word = feature),
sd AS (SELECT feature, avg(rate) AS m, stddev_samp(rate) AS sd FROM rt GROUP BY 1), zs AS (SELECT book, feature, (rate - m) / sd AS z FROM rt JOIN sd USING (feature) WHERE sd > 0),
dl AS (SELECT a.book AS book_a, b.book AS book_b, round(avg(abs(a.z - b.z)), 6) + 0.0 AS delta FROM zs a JOIN zs b ON a.feature = b.feature AND a.book < b.book GROUP BY 1, 2)
"""
_PC = f"""{_PV}, pw AS (SELECT passage_id, root, count(*) AS n FROM pv JOIN ct USING (verse_id) GROUP BY 1, 2), w AS (SELECT root, count(*) AS w FROM ct GROUP BY 1), vk AS (SELECT verse_id, coalesce(testament, '') AS t, count(*) AS k FROM tk LEFT JOIN bk USING (book) GROUP BY 1, 2),
lz AS (SELECT unnest(['H', 'G', '']) AS l, unnest(['OT', 'NT', NULL]) AS t), ez AS (SELECT l, sum(k) AS ev FROM vk JOIN lz ON lz.t IS NULL OR lz.t = vk.t GROUP BY 1), sz AS (SELECT passage_id, l, sum(k) AS size FROM pv JOIN vk USING (verse_id) JOIN lz ON lz.t IS NULL OR lz.t = vk.t GROUP BY 1, 2),
px AS (SELECT pw.passage_id, pw.root, n, w, size, ev FROM pw JOIN w USING (root) JOIN sz ON sz.passage_id = pw.passage_id AND l = CASE WHEN regexp_matches(pw.root, '^[HG]\\d+$') THEN substr(pw.root, 1, 1) ELSE '' END JOIN ez USING (l) WHERE size > 0 AND ev > size)
"""
_CL = f"""{_CC}, c AS (SELECT root, sum(CASE WHEN testament = 'OT' THEN weight ELSE 0 END)::BIGINT AS a, sum(CASE WHEN testament = 'NT' THEN weight ELSE 0 END)::BIGINT AS b FROM bc JOIN bk USING (book) GROUP BY 1),
n AS (SELECT sum(n) FILTER (testament = 'OT') AS na, sum(n) FILTER (testament = 'NT') AS nb FROM ts JOIN bk USING (book)),
cl AS (SELECT root, a, b, round((a + 2.0) / (b * na / nb::DOUBLE + 2.0), 6) + 0.0 AS lift_a, round((b + 2.0) / (a * nb / na::DOUBLE + 2.0), 6) + 0.0 AS lift_b, round({M.sql_g2('a', 'b', 'na', 'nb')}, 6) + 0.0 AS keyness FROM c CROSS JOIN n WHERE a + b > 0)
"""
_ST = f"""{_T}, v AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY chapter, verse, verse_id) - 1 AS i, count(*) OVER (PARTITION BY book) AS bs FROM vb WHERE book IS NOT NULL),
{_RO}, rr AS (SELECT root FROM ro WHERE w * 2000 <= n),
vf AS (SELECT v.book, v.i, v.bs, count(tk.position) AS words, count(*) FILTER (tk.root IS NOT NULL AND NOT tk.is_stop) AS content, count(*) FILTER (tk.root IS NOT NULL AND NOT tk.is_stop AND rr.root IS NOT NULL) AS rare,
  count(*) FILTER (tk.root IS NOT NULL AND NOT tk.is_stop AND regexp_matches(tk.morph, '^[HG]?V|^HV|^V')) AS verbs FROM v LEFT JOIN tk USING (verse_id) LEFT JOIN rr ON rr.root = tk.root GROUP BY 1, 2, 3),
wn AS (SELECT book, i AS start, bs, count(*) OVER q AS vs, sum(words) OVER q AS words, sum(content) OVER q AS content, sum(rare) OVER q AS rare, sum(verbs) OVER q AS verbs FROM vf WINDOW q AS (PARTITION BY book ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
wk0 AS (SELECT * FROM wn WHERE vs = 10 OR (start = 0 AND bs < 10)),
sp AS (SELECT book, start, 'density' AS measure, content::BIGINT AS k, words::BIGINT AS n FROM wk0 UNION ALL SELECT book, start, 'rare', rare::BIGINT, content::BIGINT FROM wk0 UNION ALL SELECT book, start, 'action', verbs::BIGINT, content::BIGINT FROM wk0),
ss AS (SELECT *, CASE WHEN n > 0 THEN round(k / n::DOUBLE, 6) + 0.0 ELSE 0.0 END AS score FROM sp),
sm AS (SELECT measure, avg(score) AS m, stddev_samp(score) AS sd, sum(k) AS ak, sum(n) AS an, count(*) AS c FROM ss GROUP BY 1),
sz AS (SELECT book, start, measure, CASE WHEN sd > 0 THEN round((score - m) / sd, 5) + 0.0 ELSE 0.0 END AS z FROM ss JOIN sm USING (measure))
"""

QUERIES = {
    f.__name__: f
    for f in (phrase_weight, concentration, local_rendering, group_keyness, book_lift, passage_lift, passage_absence, compare_layers, leaning_words, delta, nearest_books, delta_yardstick, delta_detail, function_profile, richness, reach_depth,
              dice_books, chapter_shifts, section_words, halves, strips, strip_hammer, strip_variety, strip_z, strip_percentile, strip_bell, strip_g2, spots, chapter_strip)
}

SQL = {
    "phrase_weight": f"""{_FR}, {_RO}, r AS (SELECT root, rarity FROM ro), u AS (SELECT phrase, unnest(string_split(phrase, ' ')) AS unit FROM ec)
      SELECT phrase, round(sum(coalesce(rarity, 0)), 6) + 0.0 AS weight FROM u LEFT JOIN r ON r.root = unit GROUP BY 1""",
    "concentration": f"""{_WB}, t AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY keyness DESC, root) AS k FROM wk WHERE keyness > 0) SELECT book, round(sum(CASE WHEN k <= 3 THEN keyness ELSE 0 END) / sum(keyness), 6) + 0.0 AS top_three FROM t WHERE k <= 25 GROUP BY 1""",
    "local_rendering": f"""{_T}, c AS (SELECT * FROM ct WHERE surface IS NOT NULL), h AS (SELECT book, root, surface, count(*) AS uses FROM c GROUP BY 1, 2, 3),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book, root ORDER BY uses DESC, surface) AS k FROM h) WHERE k = 1 AND uses >= 3),
      f AS (SELECT root, surface, count(*) AS form_uses FROM c GROUP BY 1, 2), r AS (SELECT root, count(*) AS root_uses FROM c GROUP BY 1)
      SELECT book, root, surface, uses, form_uses, root_uses FROM b JOIN f USING (root, surface) JOIN r USING (root) WHERE uses * 2 >= form_uses AND form_uses * 2 < root_uses""",
    "group_keyness": f"""{_CC}, b AS (SELECT bc.*, baseline_group AS g FROM bc JOIN bk USING (book) WHERE baseline_group IS NOT NULL), o AS (SELECT book, sum(n) AS own FROM ts GROUP BY 1), t AS (SELECT baseline_group AS g, sum(own) AS gt FROM o JOIN bk USING (book) GROUP BY 1), r AS (SELECT g, root, sum(weight) AS gr FROM b GROUP BY 1, 2),
      k AS (SELECT book, root, weight, round({M.sql_g2('weight', 'gr - weight', 'own', 'gt - own')}, 6) + 0.0 AS keyness FROM b JOIN o USING (book) JOIN t USING (g) JOIN r USING (g, root)) SELECT * FROM k WHERE keyness >= 6.63""",
    "book_lift": f"""{_BL}, z AS (SELECT book, sum(n) AS total FROM ts GROUP BY 1), pt AS (SELECT pr.book, sum(total) AS pt FROM pr JOIN z ON z.book = peer GROUP BY 1), pc AS (SELECT pr.book, root, sum(weight) AS pw FROM pr JOIN bc ON bc.book = peer GROUP BY 1, 2)
      SELECT bc.book, bc.root, weight AS observed, round(coalesce(pw, 0) * total / pt::DOUBLE, 6) + 0.0 AS expected, round((weight + 2.0) / (coalesce(pw, 0) * total / pt::DOUBLE + 2.0), 6) + 0.0 AS lift FROM bc JOIN z USING (book) JOIN pt USING (book) LEFT JOIN pc ON pc.book = bc.book AND pc.root = bc.root""",
    "passage_lift": f"""{_PC} SELECT passage_id, root, n, round((n + 2.0) / ((w - n) * size / (ev - size)::DOUBLE + 2.0), 6) + 0.0 AS lift, round({M.sql_g2('n', 'w - n', 'size', 'ev - size')}, 6) + 0.0 AS keyness FROM px""",
    "passage_absence": f"""{_WB.replace(_T, _PV, 1)}, m AS (SELECT DISTINCT passage_id, wk.root FROM (SELECT DISTINCT passage_id, vb.book FROM pv JOIN vb USING (verse_id)) p JOIN wk USING (book) WHERE keyness >= 10.83), u AS (SELECT DISTINCT passage_id, root FROM pv JOIN ct USING (verse_id))
      SELECT m.passage_id, count(*) AS marks, count(u.root) AS used FROM m LEFT JOIN u ON u.passage_id = m.passage_id AND u.root = m.root GROUP BY 1""",
    "compare_layers": f"{_CL} SELECT * FROM cl",
    "leaning_words": f"{_CL} SELECT root, a, b, CASE WHEN lift_a >= 2 THEN 'OT' ELSE 'NT' END AS leans FROM cl WHERE (lift_a >= 2 AND a >= 5) OR (lift_b >= 2 AND b >= 5)",
    "delta": f"{_DL} SELECT * FROM dl",
    "nearest_books": f"""{_DL}, b AS (SELECT book_a AS book, book_b AS near, delta FROM dl UNION ALL SELECT book_b, book_a, delta FROM dl)
      SELECT book, rank::INT AS rank, near, delta FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY delta, near) AS rank FROM b) WHERE rank <= 5""",
    "delta_yardstick": f"""{_DL}, r AS (SELECT delta, row_number() OVER (ORDER BY delta) - 1 AS i, count(*) OVER () AS n FROM dl), s AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS share) SELECT share, delta FROM s JOIN r ON i = least(n - 1, floor(share * n)::BIGINT)""",
    "delta_detail": f"""{_DL}, q AS (SELECT book, feature, round(z, 6) + 0.0 AS z FROM zs) SELECT book, rank::INT AS rank, feature, z FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY abs(z) DESC, feature) AS rank FROM q) WHERE rank <= 5""",
    "function_profile": f"""{_DL} SELECT book, {', '.join(f"round(1000 * coalesce(sum(weight) FILTER (word = '{c}'), 0) / sum(weight)::DOUBLE, 2) AS w_{c}" for c in ('the', 'and', 'of', 'to', 'in', 'that', 'he', 'shall', 'unto', 'for', 'his', 'they'))} FROM w GROUP BY 1""",
    "richness": f"""{_CC}, r AS (SELECT root, count(*) AS books FROM bc GROUP BY 1) SELECT book, sum(weight)::BIGINT AS words, count(*) AS roots, count(*) FILTER (weight = 1) AS once, count(*) FILTER (books = 1) AS own,
      round(count(*) FILTER (weight = 1) / count(*)::DOUBLE, 6) + 0.0 AS once_share, round(1000 * count(*) FILTER (books = 1) / sum(weight)::DOUBLE, 2) AS own_per_thousand FROM bc JOIN r USING (root) GROUP BY 1""",
    "reach_depth": f"""{_WB}, ch AS (SELECT * FROM ts), wc AS (SELECT book, chapter, root, round({M.sql_g2('weight', 'lr - weight', 'n', 'lt - n')}, 6) + 0.0 AS keyness FROM lay JOIN lr USING (root) JOIN lt USING (layer) JOIN ch USING (book, chapter)),
      dp AS (SELECT book, root, max(keyness) AS depth FROM wc WHERE keyness > 0 GROUP BY 1, 2)
      SELECT book, root FROM (SELECT book, root, row_number() OVER (PARTITION BY book ORDER BY keyness DESC, root) AS k FROM wk WHERE keyness > 0) WHERE k <= 40
      UNION SELECT book, root FROM (SELECT book, root, row_number() OVER (PARTITION BY book ORDER BY depth DESC, root) AS k FROM dp) WHERE k <= 20""",
    "dice_books": f"""{_CC}, z AS (SELECT book, sum(weight) AS n FROM bc GROUP BY 1) SELECT a.book AS book_a, b.book AS book_b, round(2 * sum(least(a.weight, b.weight)) / any_value(x.n + y.n)::DOUBLE, 6) + 0.0 AS closeness FROM bc a JOIN bc b ON a.root = b.root AND a.book < b.book JOIN z x ON x.book = a.book JOIN z y ON y.book = b.book GROUP BY 1, 2""",
    "chapter_shifts": f"""{_CC}, n AS (SELECT book, chapter, sum(weight) AS n FROM cc GROUP BY 1, 2), p AS (SELECT book, chapter, root, weight / n::DOUBLE AS p FROM cc JOIN n USING (book, chapter)),
      b AS (SELECT p.book, p.chapter, sum(sqrt(p.p * q.p)) AS c FROM p JOIN p q ON q.book = p.book AND q.chapter + 1 = p.chapter AND q.root = p.root GROUP BY 1, 2)
      SELECT n.book, n.chapter, round(sqrt(greatest(0.0, 1 - coalesce(c, 0))), 6) + 0.0 AS distance FROM n JOIN n m ON m.book = n.book AND m.chapter + 1 = n.chapter LEFT JOIN b ON b.book = n.book AND b.chapter = n.chapter""",
    "section_words": f"""{_CC}, s AS (SELECT book, ((chapter - 1) // 10)::INT AS section, root, sum(weight)::BIGINT AS weight FROM cc GROUP BY 1, 2, 3), o AS (SELECT book, ((chapter - 1) // 10)::INT AS section, sum(n) AS own FROM ts GROUP BY 1, 2), t AS (SELECT book, sum(n) AS total FROM ts GROUP BY 1), r AS (SELECT book, root, sum(weight) AS br FROM s GROUP BY 1, 2),
      k AS (SELECT book, section, root, weight, round({M.sql_g2('weight', 'br - weight', 'own', 'total - own')}, 6) + 0.0 AS keyness FROM s JOIN o USING (book, section) JOIN t USING (book) JOIN r USING (book, root))
      SELECT book, section, rank::INT AS rank, root, weight, keyness FROM (SELECT *, row_number() OVER (PARTITION BY book, section ORDER BY keyness DESC, root) AS rank FROM k WHERE keyness > 0) WHERE rank <= 10""",
    "halves": f"""{_T}, v AS (SELECT book, len(words) AS w, sum(len(words)) OVER (PARTITION BY book ORDER BY chapter, verse, verse_id) - len(words) AS before, sum(len(words)) OVER (PARTITION BY book) AS total FROM un)
      SELECT book, CASE WHEN before * 2 < total THEN 1 ELSE 2 END AS half, count(*) AS verses, sum(w)::BIGINT AS words FROM v GROUP BY 1, 2""",
    "strips": f"{_ST} SELECT * FROM ss",
    "strip_z": f"{_ST} SELECT * FROM sz",
    "strip_hammer": f"""{_ST}, h AS (SELECT w.book, w.start, ct.root, count(*) AS n FROM wk0 w JOIN v ON v.book = w.book AND v.i BETWEEN w.start AND w.start + 9 JOIN ct USING (verse_id) GROUP BY 1, 2, 3)
      SELECT book, start, root AS hammer_root, n AS top FROM (SELECT *, row_number() OVER (PARTITION BY book, start ORDER BY n DESC, root) AS k FROM h) WHERE k = 1""",
    "strip_percentile": f"""{_ST}, c AS (SELECT measure, score, count(*) AS eq FROM ss GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(eq) OVER (PARTITION BY measure ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
      SELECT book, start, measure, round((below + 0.5 * eq) / c::DOUBLE, 6) + 0.0 AS percentile FROM ss JOIN b USING (measure, score) JOIN sm USING (measure)""",
    "strip_g2": f"""{_ST}, g AS (SELECT book, start, measure, {M.sql_g2('k', 'ak', 'n', 'an')} AS g FROM ss JOIN sm USING (measure)) SELECT book, start, measure, round(sign(g) * sqrt(abs(g)), 5) + 0.0 AS z FROM g""",
    "spots": f"""{_ST}, r AS (SELECT *, z >= 2 AS hot FROM sz WHERE z >= 2 OR z <= -2), f AS (SELECT *, CASE WHEN start - lag(start) OVER w <= 5 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY book, measure, hot ORDER BY start)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY book, measure, hot ORDER BY start) AS spot FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY book, measure, hot, spot ORDER BY abs(z) DESC, start) AS k FROM s)
      SELECT book, measure, hot, min(start) AS first, max(start) + 9 AS last, count(*) AS windows, max(start) FILTER (k = 1) AS peak_start, max(z) FILTER (k = 1) AS peak FROM p GROUP BY book, measure, hot, spot""",
    "chapter_strip": f"{_ST} SELECT sz.book, v.chapter, measure, round(avg(z), 4) + 0.0 AS z, count(*) AS windows FROM sz JOIN v ON v.book = sz.book AND v.i = sz.start GROUP BY 1, 2, 3",
}
