"""Likeness and links of the project's verses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmark.functions import measures as M, sequences as Q, text as T
from quillmark.operators import corpus as C, facts as X, links as L, parallels as P, similarity as S
from quillmark.plans.fact_queries import _FR, _RO, _T, _stop, _sub
from quillmark.sources.tables import table

R = M.rounded


def kin(spark: SparkSession, d: str) -> DataFrame:
    return S.kin(C.tokens(spark, d), C.books(spark, d)).select("verse_a", "verse_b", "shared", R(F.col("score")).alias("score"))


def kin_ordered(spark: SparkSession, d: str) -> DataFrame:
    return S.kin_ordered(S.kin(C.tokens(spark, d), C.books(spark, d))).withColumn("score", R(F.col("score")))


def shared_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return S.shared_vocabulary(C.content(spark, d)).withColumn("weight", R(F.col("weight")))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return S.runs_of(C.units(spark, d), 4, of="words")


def _run_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.run_pairs(_runs(spark, d))


def run_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each run of four words that verses share, with its verses."""
    return S.run_classes(_runs(spark, d))


def parallel_runs(spark: SparkSession, d: str) -> DataFrame:
    """Verses of two books that share runs of four words, with the number of runs."""
    return _run_pairs(spark, d).where("book_a <> book_b")


def parallels(spark: SparkSession, d: str) -> DataFrame:
    """Verses of other books that follow each verse, by roots within a testament and by stems of the words written across."""
    sizes = C.verses(spark, d).where("book is not null").groupBy("book").agg(F.count("*").alias("verses"))
    words = C.tokens(spark, d).select("verse_id", "book", "position", F.when(~F.col("is_stop"), F.col("root")).alias("root"), F.lower("surface").alias("word"))
    layers = C.books(spark, d).select("book", F.col("testament").alias("layer"))
    return P.parallels(words, layers, sizes, T.stemmed).withColumn("likeness", R(F.col("likeness")))


def synopsis(spark: SparkSession, d: str) -> DataFrame:
    """For each verse its four best parallels in other books."""
    p = _run_pairs(spark, d).where("book_a <> book_b")
    both = p.select("verse_a", "verse_b", "book_b", "hits").unionByName(p.select(F.col("verse_b").alias("verse_a"), F.col("verse_a").alias("verse_b"), F.col("book_a").alias("book_b"), "hits"))
    return X.top_k(both, ["verse_a"], [F.desc("hits"), F.col("verse_b")], 4).select("verse_a", "rank", "verse_b", "book_b", "hits")


def compare_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of two books by the formulas of three words or more they share, of those in at most twelve verses."""
    runs = X.formulas(C.units(spark, d), (3, 4, 5))
    kept = X.formula_facts(runs).where("verses <= 12 and books >= 2").where(X.substance(F.col("display")))
    at = runs.join(kept.select("phrase"), "phrase", "left_semi").select("phrase", "book", "chapter").distinct()
    sets = at.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("book", "chapter"))).alias("c"))
    first = sets.select("phrase", "c", F.posexplode("c").alias("i", "a"))
    pairs = first.select("phrase", "a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b")).where("a.book <> b.book")
    return pairs.groupBy(F.col("a.book").alias("book_a"), F.col("a.chapter").alias("chapter_a"), F.col("b.book").alias("book_b"), F.col("b.chapter").alias("chapter_b")).agg(F.count("*").alias("shared"))


def bridged_verses(spark: SparkSession, d: str) -> DataFrame:
    """Verses in different languages joined by a rare wording."""
    runs = X.formulas(C.units(spark, d), (3, 4, 5))
    w = X.echoes_across(runs).select("wording")
    at = runs.join(w, "wording", "left_semi").where("language is not null").select("wording", "verse_id", "language").distinct()
    sets = at.groupBy("wording").agg(F.sort_array(F.collect_list(F.struct("verse_id", "language"))).alias("v"))
    first = sets.select("v", F.posexplode("v").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b")).where("a.language <> b.language")
    return pairs.groupBy(F.col("a.verse_id").alias("verse_a"), F.col("b.verse_id").alias("verse_b")).agg(F.count("*").alias("wordings"))


def near_far_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of four units or more that the two testaments share, at their full length."""
    t = C.books(spark, d).select("book", "testament")
    runs = S.runs_of(C.units(spark, d), 4).join(t, "book")
    return S.maximal_runs(runs.where("testament = 'NT'"), runs.where("testament = 'OT'"), 4, 6)


def _names(spark: SparkSession, d: str) -> DataFrame:
    return L.book_names(table(spark, d, "books"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return L.link_votes(table(spark, d, "cross_references"), _names(spark, d), C.verses(spark, d))


def link_votes(spark: SparkSession, d: str) -> DataFrame:
    return _votes(spark, d)


def links_between(spark: SparkSession, d: str) -> DataFrame:
    """Links of at least two votes that leave a book for another."""
    n = _names(spark, d)
    refs = table(spark, d, "cross_references").where("relevance_score >= 2").select("id", L.book_key("from_book").alias("f"), L.book_key("to_book").alias("t"), "relevance_score").distinct()
    out = refs.join(n.select(F.col("key").alias("f"), F.col("book").alias("from_name")), "f").join(n.select(F.col("key").alias("t"), F.col("book").alias("to_name")), "t").where("from_name <> to_name")
    return out.groupBy("from_name", "to_name").agg(F.count_distinct("id").alias("links"), F.max("relevance_score").alias("best"))


def links_covered(spark: SparkSession, d: str) -> DataFrame:
    """Listed verse links, and whether an echo between the verses was found too."""
    r = X.formulas(C.units(spark, d))
    at = X.places(r, X.echoes(X.formula_facts(r))).select("phrase", "verse_id").distinct()
    sets = at.groupBy("phrase").agg(F.sort_array(F.collect_list("verse_id")).alias("v"))
    first = sets.select("v", F.posexplode("v").alias("i", "low"))
    found = first.select("low", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("high")).distinct().withColumn("found", F.lit(True))
    v = _votes(spark, d).select(F.least("from_verse", "to_verse").alias("low"), F.greatest("from_verse", "to_verse").alias("high"), "votes").groupBy("low", "high").agg(F.max("votes").alias("votes"))
    return v.join(found, ["low", "high"], "left").select("low", "high", "votes", F.coalesce("found", F.lit(False)).alias("found"))


#: A theme that cites more verses than this is a list, not a reading of two together.
CITED_MOST = 12


def _cited(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "theme_verse").where("theme_id is not null and verse_id is not null").select("theme_id", "verse_id").distinct()
    t = t.join(C.verses(spark, d).select("verse_id"), "verse_id")
    return t.join(t.groupBy("theme_id").agg(F.count("*").alias("verses")), "theme_id")


def cited_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Verses that themes cite together, with the number of themes. Themes of more than twelve verses are lists, which ``cited_lists`` gives."""
    sets = _cited(spark, d).where(F.col("verses") <= CITED_MOST).groupBy("theme_id").agg(F.sort_array(F.collect_list("verse_id")).alias("v"))
    first = sets.select("theme_id", "v", F.posexplode("v").alias("i", "verse_a"))
    return first.select("theme_id", "verse_a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("verse_b")).groupBy("verse_a", "verse_b").agg(F.count("*").alias("themes"))


def cited_lists(spark: SparkSession, d: str) -> DataFrame:
    """The verses of the themes that are lists: a class each, not expanded into pairs."""
    return _cited(spark, d).where(F.col("verses") > CITED_MOST).select("theme_id", "verse_id", "verses")


def _passages(spark: SparkSession, d: str) -> DataFrame:
    b = C.books(spark, d).select("book", "book_num")
    r = table(spark, d, "passage_ranges").where("passage_id is not null").select("passage_id", "book_num", "chapter_start", "verse_start", "chapter_end", "verse_end").distinct()
    return L.in_ranges(r.join(b, "book_num"), C.verses(spark, d)).select("passage_id", "verse_id").distinct()


def passage_verses(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d)


def passage_words(spark: SparkSession, d: str) -> DataFrame:
    """Content words of each passage by root."""
    c = C.content(spark, d).groupBy("verse_id", "root").agg(F.count("*").alias("n"))
    return _passages(spark, d).join(c, "verse_id").groupBy("passage_id", "root").agg(F.sum("n").alias("n"))


def theme_roles(spark: SparkSession, d: str) -> DataFrame:
    """Verses of each theme by role, and how many of them lack a verse of the text."""
    t = table(spark, d, "theme_verse").select("id", "theme_id", "role", "verse_id").distinct()
    out = t.join(C.verses(spark, d).select("verse_id", F.lit(1).alias("there")), "verse_id", "left")
    return out.groupBy("theme_id", "role").agg(F.count("*").alias("verses"), F.count_if(F.col("there").isNull()).alias("missing"))


def theme_strip(spark: SparkSession, d: str) -> DataFrame:
    """Lift of each theme in each chapter it touches; what is expected goes by the chapter's verses. Excluded verses don't count."""
    t = table(spark, d, "theme_verse").where("theme_id is not null and coalesce(role, '') <> 'excluded'").select("theme_id", "verse_id").distinct()
    v = C.verses(spark, d).where("book is not null")
    n = t.join(v, "verse_id").groupBy("theme_id", "book", "chapter").agg(F.count("*").alias("observed"))
    size = v.groupBy("book", "chapter").agg(F.count("*").alias("size"))
    total = n.groupBy("theme_id").agg(F.sum("observed").alias("total"))
    out = n.join(size, ["book", "chapter"]).join(total, "theme_id").withColumn("every", size.agg(F.sum("size")).scalar())
    expected = F.col("total") * F.col("size") / F.col("every")
    return out.select("theme_id", "book", "chapter", "observed", R(expected).alias("expected"), R(M.lift("observed", expected)).alias("lift"))


_LN = f"""{_T}, bn AS (SELECT key, min(name) AS book FROM (SELECT name, unnest([lower(name), lower(abbreviation)]) AS key FROM books WHERE name IS NOT NULL) WHERE key IS NOT NULL GROUP BY 1),
cr AS (SELECT DISTINCT id, regexp_replace(lower(trim(from_book)), '\\.$', '') AS f, regexp_replace(lower(trim(to_book)), '\\.$', '') AS t, from_chapter, from_verse_start, coalesce(from_verse_end, from_verse_start) AS fe, to_chapter, to_verse_start, coalesce(to_verse_end, to_verse_start) AS te, relevance_score FROM cross_references),
la AS (SELECT DISTINCT id, verse_id AS from_verse FROM cr JOIN bn ON bn.key = f JOIN vb ON vb.book = bn.book AND vb.chapter = from_chapter AND vb.verse BETWEEN from_verse_start AND fe),
lb AS (SELECT DISTINCT id, verse_id AS to_verse FROM cr JOIN bn ON bn.key = t JOIN vb ON vb.book = bn.book AND vb.chapter = to_chapter AND vb.verse BETWEEN to_verse_start AND te),
sc AS (SELECT id, max(relevance_score) AS score FROM cross_references GROUP BY 1),
lv AS (SELECT from_verse, to_verse, max(score) AS votes FROM la JOIN lb USING (id) JOIN sc USING (id) GROUP BY 1, 2)
"""
_RUNS4 = f"""r4 AS (SELECT verse_id, book, chapter, i AS at_, array_to_string(list_slice(_OF_, i, i + 3), ' ') AS run, list_slice(words, i, i + 3) AS w
  FROM (SELECT *, unnest(range(1, len(_OF_) - 2)) AS i FROM un WHERE _IF_ len(_OF_) >= 4)),
rn AS (SELECT * FROM r4 WHERE len(list_filter(w, lambda x: x NOT IN {_stop})) >= 2)
"""
_RU = f"{_T}, " + _RUNS4.replace("_OF_", "units").replace("_IF_", "len(units) = len(words) AND")
_RN = f"{_T}, " + _RUNS4.replace("_OF_", "words").replace("_IF_", "") + """, rd AS (SELECT DISTINCT run, verse_id, book FROM rn), rk AS (SELECT run, count(*) AS verses, count(DISTINCT book) AS books FROM rd GROUP BY 1 HAVING count(*) > 1),
rp AS (SELECT a.verse_id AS verse_a, a.book AS book_a, b.verse_id AS verse_b, b.book AS book_b, count(*) AS hits FROM rd a JOIN rd b ON a.run = b.run AND a.verse_id < b.verse_id GROUP BY 1, 2, 3, 4)
"""
_CI = f"""{_T}, t AS (SELECT DISTINCT theme_id, tv.verse_id FROM theme_verse tv JOIN vb ON vb.verse_id = tv.verse_id WHERE theme_id IS NOT NULL), z AS (SELECT theme_id, count(*) AS verses FROM t GROUP BY 1)
"""
_KN = f"""{_T}, {_RO}, ra AS (SELECT root, rarity FROM ro WHERE w * 2000 <= n), v AS (SELECT verse_id, root, rarity, min(position) AS at_ FROM ct JOIN ra USING (root) GROUP BY 1, 2, 3),
kn AS (SELECT a.verse_id AS verse_a, b.verse_id AS verse_b, count(*)::INT AS shared, sum(a.rarity) AS score, list(a.root ORDER BY a.at_, a.root) AS oa, list(b.root ORDER BY b.at_, b.root) AS ob
  FROM v a JOIN v b ON a.root = b.root AND a.verse_id < b.verse_id GROUP BY 1, 2 HAVING count(*) >= 3)
"""
_PA = f"""{_T}, kw AS (SELECT DISTINCT lower(surface) AS word FROM tk WHERE surface IS NOT NULL), sm AS ({T.sql_stems("kw", "kw")}),
cu AS (SELECT 'root' AS kind, verse_id, book, list(root ORDER BY position) AS u FROM ct GROUP BY 2, 3
  UNION ALL SELECT 'stem', verse_id, book, list(coalesce(stem, '') ORDER BY position) FROM ct LEFT JOIN sm ON sm.word = lower(coalesce(surface, '')) GROUP BY 2, 3),
cl AS (SELECT cu.*, testament AS layer FROM cu LEFT JOIN bk USING (book)),
cd AS (SELECT DISTINCT kind, verse_id, book, layer, unnest(u) AS t FROM cl),
cz AS (SELECT book, count(*) AS z FROM vb WHERE book IS NOT NULL GROUP BY 1),
sk AS (SELECT kind, book, t FROM cd JOIN cz USING (book) GROUP BY kind, book, t, z HAVING count(*) > 0.1 * z),
ks AS (SELECT kind, book, list(t) AS skip FROM sk GROUP BY 1, 2),
ca AS (SELECT * FROM cd ANTI JOIN sk USING (kind, book, t)),
cp AS (SELECT a.kind, a.book AS book_a, a.verse_id AS verse_a, b.verse_id AS verse_b, b.book AS book_b FROM ca a JOIN cd b ON a.kind = b.kind AND a.t = b.t AND a.book <> b.book
  AND (a.kind = 'root') = (a.layer IS NOT DISTINCT FROM b.layer) GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 3),
cq AS (SELECT cp.*, list_filter(x.u, lambda i: NOT list_contains(coalesce(skip, []), i)) AS ua, list_filter(y.u, lambda i: NOT list_contains(coalesce(skip, []), i)) AS ub
  FROM cp JOIN cl x ON x.kind = cp.kind AND x.verse_id = verse_a JOIN cl y ON y.kind = cp.kind AND y.verse_id = verse_b LEFT JOIN ks ON ks.kind = cp.kind AND ks.book = book_a),
cr2 AS (SELECT *, {Q.sql_lcs('ua', 'ub')} AS common FROM cq)
"""
_PV = f"""{_T}, pv AS (SELECT DISTINCT passage_id, verse_id FROM passage_ranges r JOIN bk ON bk.book_num = r.book_num JOIN vb ON vb.book = bk.book WHERE passage_id IS NOT NULL AND chapter_start IS NOT NULL AND verse_start IS NOT NULL
  AND (vb.chapter > chapter_start OR (vb.chapter = chapter_start AND vb.verse >= verse_start))
  AND (vb.chapter < coalesce(chapter_end, chapter_start) OR (vb.chapter = coalesce(chapter_end, chapter_start) AND vb.verse <= coalesce(verse_end, CASE WHEN coalesce(chapter_end, chapter_start) = chapter_start THEN verse_start ELSE 1000000 END))))
"""

QUERIES = {
    f.__name__: f
    for f in (kin, kin_ordered, shared_vocabulary, run_classes, parallel_runs, parallels, synopsis, compare_chapters, bridged_verses, near_far_runs, link_votes, links_between, links_covered, cited_pairs, cited_lists, passage_verses, passage_words, theme_roles, theme_strip)
}

SQL = {
    "kin": f"{_KN} SELECT verse_a, verse_b, shared, round(score, 6) + 0.0 AS score FROM kn",
    "kin_ordered": f"""{_KN} SELECT verse_a, verse_b, shared, o::INT AS in_order, round(score * (1 + 0.5 * o / shared::DOUBLE), 6) + 0.0 AS score FROM (SELECT *, {Q.sql_lcs('oa', 'ob')} AS o FROM kn)""",
    "run_classes": f"{_RN} SELECT rd.*, verses, books FROM rd JOIN rk USING (run)",
    "parallels": f"""{_PA} SELECT verse_a, book_a, verse_b, book_b, common::INT AS common, round(common / least(len(ua), len(ub))::DOUBLE, 6) + 0.0 AS likeness FROM cr2 WHERE common >= 3 AND common >= 0.3 * least(len(ua), len(ub))""",
    "cited_lists": f"{_CI} SELECT theme_id, verse_id, verses FROM t JOIN z USING (theme_id) WHERE verses > 12",
    "shared_vocabulary": f"""{_T}, c AS (SELECT DISTINCT book, chapter, root FROM ct), z AS (SELECT book, count(DISTINCT chapter) AS n FROM c GROUP BY 1), f AS (SELECT book, root, count(*) AS df FROM c GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 5)
      SELECT a.book, a.chapter AS chapter_a, b.chapter AS chapter_b, count(*) AS shared, round(sum(ln(n / df::DOUBLE)), 6) + 0.0 AS weight FROM c a JOIN c b ON a.book = b.book AND a.root = b.root AND a.chapter < b.chapter JOIN f ON f.book = a.book AND f.root = a.root JOIN z ON z.book = a.book GROUP BY 1, 2, 3""",
    "parallel_runs": f"{_RN} SELECT * FROM rp WHERE book_a <> book_b",
    "synopsis": f"""{_RN}, q AS (SELECT verse_a, verse_b, book_b, hits FROM rp WHERE book_a <> book_b UNION ALL SELECT verse_b, verse_a, book_a, hits FROM rp WHERE book_a <> book_b)
      SELECT verse_a, rank::INT AS rank, verse_b, book_b, hits FROM (SELECT *, row_number() OVER (PARTITION BY verse_a ORDER BY hits DESC, verse_b) AS rank FROM q) WHERE rank <= 4""",
    "compare_chapters": f"""{_FR}, k AS (SELECT phrase FROM fd WHERE n >= 3 AND verses <= 12 AND books >= 2 AND {_sub('display')}),
      a AS (SELECT DISTINCT phrase, book, chapter FROM fr WHERE phrase IN (SELECT phrase FROM k))
      SELECT x.book AS book_a, x.chapter AS chapter_a, y.book AS book_b, y.chapter AS chapter_b, count(*) AS shared FROM a x JOIN a y ON x.phrase = y.phrase AND x.book < y.book GROUP BY 1, 2, 3, 4""",
    "bridged_verses": f"""{_FR}, w AS (SELECT wording FROM fr WHERE n >= 3 AND language IS NOT NULL GROUP BY 1 HAVING count(DISTINCT verse_id) BETWEEN 2 AND 6 AND count(DISTINCT book) >= 2 AND count(DISTINCT language) >= 2 AND {_sub('wording')}),
      a AS (SELECT DISTINCT wording, verse_id, language FROM fr WHERE n >= 3 AND language IS NOT NULL AND wording IN (SELECT wording FROM w))
      SELECT x.verse_id AS verse_a, y.verse_id AS verse_b, count(*) AS wordings FROM a x JOIN a y ON x.wording = y.wording AND x.verse_id < y.verse_id AND x.language <> y.language GROUP BY 1, 2""",
    "near_far_runs": f"""{_RU}, o AS (SELECT rn.* FROM rn JOIN bk USING (book) WHERE testament = 'OT'), t AS (SELECT rn.* FROM rn JOIN bk USING (book) WHERE testament = 'NT'),
      k AS (SELECT run FROM o GROUP BY 1 HAVING count(DISTINCT verse_id) <= 6),
      m AS (SELECT DISTINCT t.verse_id AS near_verse, o.verse_id AS far_verse, t.at_ AS na, o.at_ AS fa FROM t JOIN o USING (run) WHERE run IN (SELECT run FROM k)),
      i AS (SELECT *, na - row_number() OVER (PARTITION BY near_verse, far_verse, na - fa ORDER BY na) AS isl FROM m)
      SELECT near_verse, far_verse, min(na)::INT AS near_at, min(fa)::INT AS far_at, count(*) + 3 AS length FROM i GROUP BY near_verse, far_verse, na - fa, isl""",
    "link_votes": f"{_LN} SELECT * FROM lv",
    "links_between": f"""{_LN} SELECT x.book AS from_name, y.book AS to_name, count(DISTINCT id) AS links, max(relevance_score) AS best FROM cr JOIN bn x ON x.key = f JOIN bn y ON y.key = t WHERE relevance_score >= 2 AND x.book <> y.book GROUP BY 1, 2""",
    "links_covered": f"""{_FR.replace(_T, _LN, 1)}, fo AS (SELECT DISTINCT a.verse_id AS low, b.verse_id AS high FROM ep a JOIN ep b ON a.phrase = b.phrase AND a.verse_id < b.verse_id),
      v AS (SELECT least(from_verse, to_verse) AS low, greatest(from_verse, to_verse) AS high, max(votes) AS votes FROM lv GROUP BY 1, 2)
      SELECT v.low, v.high, votes, fo.low IS NOT NULL AS found FROM v LEFT JOIN fo USING (low, high)""",
    "cited_pairs": f"""{_CI} SELECT a.verse_id AS verse_a, b.verse_id AS verse_b, count(*) AS themes FROM t a JOIN t b ON a.theme_id = b.theme_id AND a.verse_id < b.verse_id JOIN z ON z.theme_id = a.theme_id WHERE verses <= 12 GROUP BY 1, 2""",
    "passage_verses": f"{_PV} SELECT * FROM pv",
    "passage_words": f"{_PV} SELECT passage_id, root, count(*) AS n FROM pv JOIN ct USING (verse_id) GROUP BY 1, 2",
    "theme_roles": f"""{_T} SELECT theme_id, role, count(*) AS verses, count(*) FILTER (vb.verse_id IS NULL) AS missing FROM (SELECT DISTINCT id, theme_id, role, verse_id FROM theme_verse) t LEFT JOIN vb USING (verse_id) GROUP BY 1, 2""",
    "theme_strip": f"""{_T}, t AS (SELECT DISTINCT theme_id, verse_id FROM theme_verse WHERE theme_id IS NOT NULL AND coalesce(role, '') <> 'excluded'), v AS (SELECT * FROM vb WHERE book IS NOT NULL),
      n AS (SELECT theme_id, book, chapter, count(*) AS observed FROM t JOIN v USING (verse_id) GROUP BY 1, 2, 3), z AS (SELECT book, chapter, count(*) AS size FROM v GROUP BY 1, 2), e AS (SELECT sum(size) AS ev FROM z), o AS (SELECT theme_id, sum(observed) AS total FROM n GROUP BY 1)
      SELECT theme_id, book, chapter, observed, round(total * size / ev::DOUBLE, 6) + 0.0 AS expected, round((observed + 2.0) / (total * size / ev::DOUBLE + 2.0), 6) + 0.0 AS lift FROM n JOIN z USING (book, chapter) JOIN o USING (theme_id) CROSS JOIN e""",
}
