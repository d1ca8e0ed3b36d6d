"""Fact tables of the project's text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmark.functions import measures as M
from quillmark.functions.lists import STOPLIST, VOICE_TAGS, sql_list
from quillmark.operators import corpus as C, facts as X

R = M.rounded


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    return X.chapter_counts(C.content(spark, d))


def chapter_facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts by chapter, the book list, and all words by chapter."""
    return _chapters(spark, d), C.books(spark, d), X.chapter_sizes(C.tokens(spark, d))


def weight_scales(spark: SparkSession, d: str) -> DataFrame:
    return X.weight_scales(_chapters(spark, d))


def word_book(spark: SparkSession, d: str) -> DataFrame:
    return X.book_keyness(*chapter_facts(spark, d)).select("book", "root", "weight", "verses", "chapters", R(F.col("keyness")).alias("keyness"))


def signature_words(spark: SparkSession, d: str) -> DataFrame:
    """The 25 words of highest keyness of each book, with their spread over the book's chapters."""
    rows = word_book(spark, d)
    top = X.top_k(rows.where("keyness > 0"), ["book"], [F.desc("keyness"), F.col("root")], 25)
    size = C.verses(spark, d).where("book is not null").groupBy("book").agg(F.count_distinct("chapter").alias("book_chapters"))
    share = F.col("chapters") / F.col("book_chapters")
    return top.join(size, "book").select("book", "rank", "root", "weight", "keyness", R(F.col("keyness") * share).alias("spread"), (share < 0.2).alias("local"))


def word_chapter(spark: SparkSession, d: str) -> DataFrame:
    return X.chapter_keyness(*chapter_facts(spark, d)).withColumn("keyness", R(F.col("keyness")))


def depth(spark: SparkSession, d: str) -> DataFrame:
    return X.depth(X.chapter_keyness(*chapter_facts(spark, d)), ["book", "root"])


def common_form(spark: SparkSession, d: str) -> DataFrame:
    return X.commonest(C.content(spark, d).where("surface is not null"), ["root"], "surface")


def book_totals(spark: SparkSession, d: str) -> DataFrame:
    v = C.units(spark, d).groupBy("book").agg(F.count_distinct("chapter").alias("chapters"), F.count("*").alias("verses"), F.sum(F.size("words")).cast("long").alias("words"))
    t = C.tokens(spark, d).groupBy("book").agg(F.count("*").alias("tokens"), F.count_if(F.expr("root is not null and not is_stop")).alias("content"))
    return v.join(t, "book", "left").select("book", "chapters", "verses", "words", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("content", F.lit(0)).alias("content"))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return X.neighbours(C.tokens(spark, d))


def focus_windows(spark: SparkSession, d: str) -> DataFrame:
    return X.focus_windows(C.tokens(spark, d))


def _pull(spark: SparkSession, d: str) -> DataFrame:
    t = C.tokens(spark, d)
    return X.pull(X.neighbours(t), X.focus_windows(t), X.chapter_sizes(t))


def pull(spark: SparkSession, d: str) -> DataFrame:
    return _pull(spark, d).withColumn("pull", R(F.col("pull")))


def shadow(spark: SparkSession, d: str) -> DataFrame:
    return X.shadow(_pull(spark, d)).withColumn("shadow", R(F.col("shadow"), 4))


def neighbours_beside(spark: SparkSession, d: str) -> DataFrame:
    """The 15 strongest neighbours of each word in all the text with at least five occurrences."""
    focus = X.with_total(X.focus_windows(C.tokens(spark, d)), ["focus"], ["occurrences"]).where(f"scope = '{X.ALL}' and occurrences >= 5").select("focus")
    rows = pull(spark, d).where(f"scope = '{X.ALL}' and pull > 0").join(focus, "focus", "left_semi")
    return X.top_k(rows, ["focus"], [F.desc("pull"), F.col("neighbour")], 15).select("focus", "rank", "neighbour", "n", "pull")


def neighbours_rest(spark: SparkSession, d: str) -> DataFrame:
    """For each book's pairs, the same pair in all other books: total less own, at least 2, with its pull there."""
    t = C.tokens(spark, d)
    n, f = X.neighbours(t), X.focus_windows(t)
    total = n.groupBy("focus", "neighbour").agg(F.sum("n").alias("all_n"))
    whole = f.groupBy("focus").agg(F.sum("inside").alias("all_inside"), F.sum("occurrences").alias("all_w"))
    size = X.chapter_sizes(t).groupBy("book").agg(F.sum("words").alias("book_total"))
    every = size.agg(F.sum("book_total")).scalar()
    rest = n.join(total, ["focus", "neighbour"]).withColumn("rest", F.col("all_n") - F.col("n")).where("rest >= 2")
    own = f.select("book", "focus", "inside")
    own_w = f.select("book", F.col("focus").alias("neighbour"), F.col("occurrences").alias("own_w"))
    nw = whole.select(F.col("focus").alias("neighbour"), F.col("all_w"))
    out = rest.join(own, ["book", "focus"]).join(own_w, ["book", "neighbour"]).join(whole.select("focus", "all_inside"), "focus").join(nw, "neighbour").join(size, "book").withColumn("every", every)
    inside = F.col("all_inside") - F.col("inside")
    return out.select("book", "focus", "neighbour", "rest", R(M.g2("rest", F.col("all_w") - F.col("own_w") - F.col("rest"), inside, F.col("every") - F.col("book_total") - inside)).alias("pull"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return X.formulas(C.units(spark, d))


def formulas(spark: SparkSession, d: str) -> DataFrame:
    return X.formula_facts(_runs(spark, d))


def formula_book(spark: SparkSession, d: str) -> DataFrame:
    """Verses and uses of each formula by book, for formulas in two verses or more."""
    r = _runs(spark, d)
    v = r.groupBy("phrase", "book", "verse_id").agg(F.count("*").alias("t")).groupBy("phrase", "book").agg(F.count("*").alias("verses"), F.sum("t").alias("times"))
    kept = v.groupBy("phrase").agg(F.sum("verses").alias("s")).where("s >= 2").select("phrase")
    return v.join(kept, "phrase", "left_semi")


def echoes(spark: SparkSession, d: str) -> DataFrame:
    return X.echoes(X.formula_facts(_runs(spark, d))).select("phrase", "n", "verses", "books", "display", ((F.col("n") >= 5) & (F.col("verses") == 2)).alias("quotation"))


def echo_places(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d)
    return X.places(r, X.echoes(X.formula_facts(r))).select("phrase", "verse_id", "book")


def echo_partners(spark: SparkSession, d: str) -> DataFrame:
    """Echoes that two books share, with what their sizes let expect."""
    r = _runs(spark, d)
    p = X.partners(X.places(r, X.echoes(X.formula_facts(r))))
    both = p.select(F.explode(F.array(F.struct(F.col("book_a").alias("book"), F.col("book_b").alias("partner")), F.struct(F.col("book_b").alias("book"), F.col("book_a").alias("partner")))).alias("x"), "echoes").select("x.book", "x.partner", "echoes")
    size = C.units(spark, d).groupBy("book").agg(F.sum(F.size("words")).cast("long").alias("words"))
    every = size.agg(F.sum("words")).scalar()
    total = both.groupBy("book").agg(F.sum("echoes").alias("total"))
    out = both.join(total, "book").join(size.withColumnRenamed("words", "own"), "book").join(size.select(F.col("book").alias("partner"), "words"), "partner").withColumn("every", every)
    return out.select("book", "partner", "echoes", R(F.col("total") * F.col("words") / (F.col("every") - F.col("own"))).alias("expected"))


def echoes_across(spark: SparkSession, d: str) -> DataFrame:
    return X.echoes_across(_runs(spark, d))


_T = f"WITH {C.SQL}"
_CC = f"""{_T}, cc AS (SELECT book, chapter, root, count(*) AS weight, count(DISTINCT verse_id) AS verses FROM ct GROUP BY 1, 2, 3),
bc AS (SELECT book, root, sum(weight)::BIGINT AS weight, sum(verses)::BIGINT AS verses, count(*) AS chapters FROM cc GROUP BY 1, 2),
ts AS (SELECT book, chapter, count(*) AS n FROM tk GROUP BY 1, 2),
lay AS (SELECT cc.*, CASE WHEN regexp_matches(root, '^[HG]\\d+$') THEN coalesce(testament, '') ELSE '(all)' END AS layer, coalesce(testament, '') AS testament FROM cc LEFT JOIN bk USING (book)),
lr AS (SELECT root, sum(weight) AS lr FROM cc GROUP BY 1),
lt AS (SELECT coalesce(testament, '') AS layer, sum(n) AS lt FROM ts LEFT JOIN bk USING (book) GROUP BY 1 UNION ALL SELECT '(all)', sum(n) FROM ts)
"""
_WB = f"""{_CC}, bt AS (SELECT book, sum(n) AS bt FROM ts GROUP BY 1),
wb AS (SELECT book, root, sum(weight)::BIGINT AS weight, sum(verses)::BIGINT AS verses, count(*) AS chapters, any_value(lr) AS lr, any_value(lt) AS lt, any_value(bt) AS bt FROM lay JOIN lr USING (root) JOIN lt USING (layer) JOIN bt USING (book) GROUP BY 1, 2),
wk AS (SELECT book, root, weight, verses, chapters, round({M.sql_g2('weight', 'lr - weight', 'bt', 'lt - bt')}, 6) + 0.0 AS keyness FROM wb)
"""
_WC = f"""{_CC}, ch AS (SELECT * FROM ts),
wc AS (SELECT book, chapter, root, weight, verses, round({M.sql_g2('weight', 'lr - weight', 'n', 'lt - n')}, 6) + 0.0 AS keyness FROM lay JOIN lr USING (root) JOIN lt USING (layer) JOIN ch USING (book, chapter))
"""
_RO = """wt AS (SELECT root, count(*) AS w FROM ct GROUP BY 1), tn AS (SELECT coalesce(testament, '') AS t, count(*) AS n FROM tk LEFT JOIN bk USING (book) GROUP BY 1),
ro AS (SELECT root, w, n, -ln(w / n::DOUBLE) AS rarity FROM (SELECT root, w, CASE WHEN regexp_matches(root, '^H\\d+$') THEN (SELECT sum(n) FROM tn WHERE t = 'OT') WHEN regexp_matches(root, '^G\\d+$') THEN (SELECT sum(n) FROM tn WHERE t = 'NT') ELSE (SELECT sum(n) FROM tn) END AS n FROM wt))"""
_NB = f"""{_T}, ix AS (SELECT *, row_number() OVER (PARTITION BY verse_id ORDER BY position) - 1 AS i, count(*) OVER (PARTITION BY verse_id) AS m FROM tk),
nb AS (SELECT a.book, a.root AS focus, b.root AS neighbour, count(*) AS n FROM ix a JOIN ix b ON a.verse_id = b.verse_id AND a.i <> b.i AND abs(a.i - b.i) <= 5
  WHERE a.root IS NOT NULL AND b.root IS NOT NULL AND NOT a.is_stop AND NOT b.is_stop AND a.root <> b.root GROUP BY 1, 2, 3),
fw AS (SELECT book, root AS focus, count(*) AS occurrences, sum(least(i, 5) + least(m - 1 - i, 5))::BIGINT AS inside FROM ix WHERE root IS NOT NULL AND NOT is_stop GROUP BY 1, 2)
"""
_PL = f"""{_NB}, ns AS (SELECT book AS scope, focus, neighbour, n FROM nb UNION ALL SELECT '(all)', focus, neighbour, sum(n)::BIGINT FROM nb GROUP BY 2, 3 HAVING sum(n) >= 2),
fs AS (SELECT book AS scope, focus, occurrences, inside FROM fw UNION ALL SELECT '(all)', focus, sum(occurrences)::BIGINT, sum(inside)::BIGINT FROM fw GROUP BY 2),
st AS (SELECT book AS scope, count(*) AS total FROM tk GROUP BY 1 UNION ALL SELECT '(all)', count(*) FROM tk),
pl AS (SELECT ns.scope, ns.focus, ns.neighbour, n, {M.sql_g2('n', 'w.occurrences - n', 'f.inside', 'total - f.inside')} AS pull
  FROM ns JOIN fs f ON f.scope = ns.scope AND f.focus = ns.focus JOIN fs w ON w.scope = ns.scope AND w.focus = ns.neighbour JOIN st ON st.scope = ns.scope)
"""
_stop = sql_list(STOPLIST)


def _sub(c: str) -> str:
    out = f"lower({c})"
    for tag in VOICE_TAGS:
        out = f"replace({out}, '{tag}', ' ')"
    return f"len(list_filter(string_split({out}, ' '), lambda w: w <> '' AND w NOT IN {_stop})) >= 2"


_FR = f"""{_T}, nn AS (SELECT unnest([2, 3, 4, 5]) AS n),
st AS (SELECT verse_id, book, chapter, language, units, words, n, unnest(range(1, len(units) - n + 2)) AS i FROM un CROSS JOIN nn WHERE len(units) = len(words) AND len(units) >= n),
fr AS (SELECT verse_id, book, chapter, language, n, array_to_string(list_slice(units, i, i + n - 1), ' ') AS phrase, array_to_string(list_slice(words, i, i + n - 1), ' ') AS wording
  FROM st WHERE words[i + n - 1] NOT IN {_stop}),
dw AS (SELECT phrase, wording, count(*) AS t FROM fr GROUP BY 1, 2),
dd AS (SELECT phrase, wording AS display FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY t DESC, wording) AS k FROM dw) WHERE k = 1),
ff AS (SELECT phrase, n, count(DISTINCT verse_id) AS verses, count(*) AS times, count(DISTINCT book) AS books FROM fr GROUP BY 1, 2 HAVING count(DISTINCT verse_id) >= 2),
fd AS (SELECT ff.*, display FROM ff JOIN dd USING (phrase)),
ec AS (SELECT * FROM fd WHERE n >= 3 AND verses BETWEEN 2 AND 6 AND books >= 2 AND {_sub('display')}),
ep AS (SELECT DISTINCT phrase, verse_id, book FROM fr WHERE phrase IN (SELECT phrase FROM ec))
"""

QUERIES = {
    f.__name__: f
    for f in (weight_scales, word_book, signature_words, word_chapter, depth, common_form, book_totals, neighbours, focus_windows, pull, shadow, neighbours_beside, neighbours_rest, formulas, formula_book, echoes, echo_places, echo_partners, echoes_across)
}

SQL = {
    "weight_scales": f"""{_CC} SELECT book AS scope, chapter, root, weight, verses, 1::BIGINT AS chapters, 1::BIGINT AS books FROM cc
      UNION ALL SELECT book, -1, root, weight, verses, chapters, 1 FROM bc
      UNION ALL SELECT '(all)', -1, root, sum(weight)::BIGINT, sum(verses)::BIGINT, sum(chapters)::BIGINT, count(*) FROM bc GROUP BY root""",
    "word_book": f"{_WB} SELECT * FROM wk",
    "signature_words": f"""{_WB}, bs AS (SELECT book, count(DISTINCT chapter) AS n FROM vb GROUP BY 1), tp AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY keyness DESC, root) AS rank FROM wk WHERE keyness > 0)
      SELECT book, rank::INT AS rank, root, weight, keyness, round(keyness * (chapters / n::DOUBLE), 6) + 0.0 AS spread, chapters / n::DOUBLE < 0.2 AS local FROM tp JOIN bs USING (book) WHERE rank <= 25""",
    "word_chapter": f"{_WC} SELECT * FROM wc",
    "depth": f"{_WC} SELECT book, root, keyness AS depth, chapter AS depth_chapter FROM (SELECT *, row_number() OVER (PARTITION BY book, root ORDER BY keyness DESC, chapter) AS k FROM wc WHERE keyness > 0) WHERE k = 1",
    "common_form": f"""{_T}, f AS (SELECT root, surface, count(*) AS uses FROM ct WHERE surface IS NOT NULL GROUP BY 1, 2)
      SELECT root, surface, uses, total, forms FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY uses DESC, surface) AS k, (sum(uses) OVER (PARTITION BY root))::BIGINT AS total, count(*) OVER (PARTITION BY root) AS forms FROM f) WHERE k = 1""",
    "book_totals": f"""{_T} SELECT v.book, chapters, verses, words, coalesce(tokens, 0) AS tokens, coalesce(content, 0) AS content FROM
      (SELECT book, count(DISTINCT chapter) AS chapters, count(*) AS verses, sum(len(words))::BIGINT AS words FROM un GROUP BY 1) v
      LEFT JOIN (SELECT book, count(*) AS tokens, count(*) FILTER (root IS NOT NULL AND NOT is_stop) AS content FROM tk GROUP BY 1) t USING (book)""",
    "neighbours": f"{_NB} SELECT * FROM nb",
    "focus_windows": f"{_NB} SELECT * FROM fw",
    "pull": f"{_PL} SELECT scope, focus, neighbour, n, round(pull, 6) + 0.0 AS pull FROM pl",
    "shadow": f"{_PL} SELECT scope, focus, round(sum(greatest(pull, 0)), 4) + 0.0 AS shadow FROM pl GROUP BY 1, 2",
    "neighbours_beside": f"""{_PL}, q AS (SELECT focus, neighbour, n, round(pull, 6) + 0.0 AS pull FROM pl JOIN fs USING (scope, focus) WHERE scope = '(all)' AND pull > 0 AND occurrences >= 5)
      SELECT focus, rank::INT AS rank, neighbour, n, pull FROM (SELECT *, row_number() OVER (PARTITION BY focus ORDER BY pull DESC, neighbour) AS rank FROM q) WHERE rank <= 15""",
    "neighbours_rest": f"""{_NB}, al AS (SELECT focus, neighbour, sum(n)::BIGINT AS all_n FROM nb GROUP BY 1, 2), wh AS (SELECT focus, sum(inside) AS ai, sum(occurrences) AS aw FROM fw GROUP BY 1),
      sz AS (SELECT book, count(*) AS bt FROM tk GROUP BY 1), ev AS (SELECT count(*) AS ev FROM tk),
      j AS (SELECT nb.book, nb.focus, nb.neighbour, all_n - n AS rest, f.inside, o.occurrences AS ow, w1.ai - f.inside AS ins, w2.aw - o.occurrences - (all_n - n) AS b, ev - bt AS others FROM nb JOIN al USING (focus, neighbour)
        JOIN fw f ON f.book = nb.book AND f.focus = nb.focus JOIN fw o ON o.book = nb.book AND o.focus = nb.neighbour JOIN wh w1 ON w1.focus = nb.focus JOIN wh w2 ON w2.focus = nb.neighbour JOIN sz ON sz.book = nb.book CROSS JOIN ev WHERE all_n - n >= 2)
      SELECT book, focus, neighbour, rest, round({M.sql_g2('rest', 'b', 'ins', 'others - ins')}, 6) + 0.0 AS pull FROM j""",
    "formulas": f"{_FR} SELECT * FROM fd",
    "formula_book": f"{_FR} SELECT phrase, book, count(DISTINCT verse_id) AS verses, count(*) AS times FROM fr WHERE phrase IN (SELECT phrase FROM ff) GROUP BY 1, 2",
    "echoes": f"{_FR} SELECT phrase, n, verses, books, display, n >= 5 AND verses = 2 AS quotation FROM ec",
    "echo_places": f"{_FR} SELECT * FROM ep",
    "echo_partners": f"""{_FR}, p AS (SELECT a.book, b.book AS partner, count(DISTINCT a.phrase) AS echoes FROM ep a JOIN ep b ON a.phrase = b.phrase AND a.book <> b.book GROUP BY 1, 2),
      z AS (SELECT book, sum(len(words)) AS w FROM un GROUP BY 1), e AS (SELECT sum(w) AS ev FROM z), t AS (SELECT book, sum(echoes) AS total FROM p GROUP BY 1)
      SELECT p.book, p.partner, echoes, round(total * y.w / (ev - z.w)::DOUBLE, 6) + 0.0 AS expected FROM p JOIN t ON t.book = p.book JOIN z ON z.book = p.book JOIN z y ON y.book = p.partner CROSS JOIN e""",
    "echoes_across": f"""{_FR} SELECT wording, n, count(DISTINCT verse_id) AS verses, count(DISTINCT book) AS books, count(DISTINCT language) AS languages FROM fr WHERE n >= 3 AND language IS NOT NULL GROUP BY 1, 2
      HAVING count(DISTINCT verse_id) BETWEEN 2 AND 6 AND count(DISTINCT book) >= 2 AND count(DISTINCT language) >= 2 AND {_sub('wording')}""",
}
