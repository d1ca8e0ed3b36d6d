"""Look-ups, text functions and small rules over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmark.functions import measures as M, sequences as Q, text as T
from quillmark.functions.lists import LEADING, STOPLIST, sql_list
from quillmark.operators import corpus as C, facts as X, judge as J, links as L
from quillmark.plans import fact_queries as FQ
from quillmark.plans.fact_queries import _FR, _T, _WB
from quillmark.plans.link_queries import SQL as LINK_SQL, _RN, theme_strip
from quillmark.plans.mining_queries import SQL as MINING_SQL
from quillmark.plans.style_queries import SQL as STYLE_SQL, _ST
from quillmark.plans.text_queries import _BN, _PS, _REF
from quillmark.sources.tables import table

R = M.rounded


def root_verses(spark: SparkSession, d: str) -> DataFrame:
    """The verses of every root, with its uses in each."""
    t = C.tokens(spark, d).where("root is not null")
    return t.groupBy("root", "verse_id", "book", "chapter", "verse").agg(F.count("*").alias("uses"))


def formulas_outside(spark: SparkSession, d: str) -> DataFrame:
    """For each formula of a book that two of its verses hold: the verses of other books that hold it."""
    v = X.formulas(C.units(spark, d)).select("phrase", "book", "verse_id").distinct().groupBy("phrase", "book").agg(F.count("*").alias("here"))
    total = v.groupBy("phrase").agg(F.sum("here").alias("every"))
    return v.where("here >= 2").join(total, "phrase").select("phrase", "book", "here", (F.col("every") - F.col("here")).alias("outside"))


def looked_up(spark: SparkSession, d: str) -> DataFrame:
    """Verses that the themes' written references name, whatever verse they are filed under."""
    t = table(spark, d, "theme_verse").select("id", T.reference("reference").alias("r")).distinct()
    r = t.select("id", L.book_key("r.book").alias("key"), F.col("r.chapter").alias("chapter"), "r.verse_start", "r.verse_end").join(L.book_names(table(spark, d, "books")).select("key", "book"), "key")
    v = C.verses(spark, d).select("book", "chapter", "verse", "verse_id")
    return r.join(v, ["book", "chapter"]).where(F.col("verse").between(F.col("verse_start"), F.col("verse_end"))).select("id", "verse_id").distinct()


def meeting_verses(spark: SparkSession, d: str) -> DataFrame:
    """Verses where the first two signature words of their book stand within five words of each other, with the number of meetings."""
    top = FQ.signature_words(spark, d).where("rank <= 2").select("book", "rank", "root")
    two = top.where("rank = 1").select("book", F.col("root").alias("a")).join(top.where("rank = 2").select("book", F.col("root").alias("b")), "book")
    t = C.tokens(spark, d).select("book", "verse_id", "position", "root")
    x = t.join(F.broadcast(two), "book").where("root = a").select("book", "verse_id", F.col("position").alias("p"))  # two rows a book
    y = t.join(F.broadcast(two), "book").where("root = b").select("verse_id", F.col("position").alias("q"))
    met = x.join(y, "verse_id").where(F.abs(F.col("p") - F.col("q")).between(1, 5))
    return met.groupBy("book", "verse_id").agg(F.count("*").alias("meetings"))


def trimmed_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Wordings of three to five words without function words at their end and conjunctions at their beginning, and how many wordings come to one."""
    w = X.formulas(C.units(spark, d), (3, 4, 5)).select("wording").distinct()
    return w.groupBy(T.trim_formula("wording").alias("formula")).agg(F.count("*").alias("wordings"))


def word_stems(spark: SparkSession, d: str) -> DataFrame:
    """The stem of each spelling of the text."""
    w = C.tokens(spark, d).where("surface is not null").select(F.lower("surface").alias("word")).distinct()
    return T.stemmed(w, w)


def stem_index(spark: SparkSession, d: str) -> DataFrame:
    """Stems with the number of their spellings, of their uses and of the roots they translate."""
    t = C.tokens(spark, d).where("surface is not null").select(F.lower("surface").alias("word"), "root")
    return T.stemmed(t, t.select("word")).groupBy("stem").agg(F.count_distinct("word").alias("spellings"), F.count("*").alias("uses"), F.count_distinct("root").alias("roots"))


def latin_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lexicon words in Latin letters, with long vowels marked; without the marks the long form is the plain one."""
    s = table(spark, d, "lexicon_forms").where("script is not null and script <> ''").select("strongs", "script").distinct()
    s = s.withColumn("plain", T.latin_form()("script")).withColumn("long", T.latin_form(True)("script"))
    return s.withColumn("same", F.translate(F.lower("long"), "āēīōū", "aeiou") == F.lower("plain"))


def gloss_words(spark: SparkSession, d: str) -> DataFrame:
    """Glosses of the lexicon, cleaned."""
    return table(spark, d, "lexicon_forms").where("translit is not null").select("strongs", T.clean_gloss("translit").alias("gloss")).distinct()


def marked_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the corrections that hold a number, against those that hold text."""
    c = table(spark, d, "lemma_corrections").select(F.explode(F.array("strongs", "lemma", "reason", "added")).alias("cell")).where("cell is not null")
    return c.groupBy(T.is_numeric("cell").alias("numeric")).agg(F.count("*").alias("cells"))


def rate_floors(spark: SparkSession, d: str) -> DataFrame:
    """The fewest uses a rate in each book is given for."""
    return FQ.book_totals(spark, d).select("book", "words", M.occurrence_floor("words").alias("floor"))


def lift_colours(spark: SparkSession, d: str) -> DataFrame:
    """The colour of each theme's lift in a chapter."""
    return theme_strip(spark, d).select("theme_id", "book", "chapter", T.strip_colour("lift").alias("colour"))


def rare_limit(spark: SparkSession, d: str) -> DataFrame:
    """The limit of uses under which the two testaments have the most equal share of rare words."""
    c = C.content(spark, d).join(C.books(spark, d).select("book", F.col("testament").alias("layer")), "book").where("layer is not null")
    return J.balanced_limit(c.groupBy("layer", "root").agg(F.count("*").alias("weight"))).select("limit", R(F.col("gap")).alias("gap"))


def grown_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Formulas of two verses of a book or more, grown to both sides as long as all its verses go on with the same unit."""
    return X.grown(C.units(spark, d)).select("book", "phrase", "verses", "grown")


def folded_signatures(spark: SparkSession, d: str) -> DataFrame:
    """The grown formulas of highest keyness of each book, each once, without those whose verses a longer one covers."""
    u = C.units(spark, d)
    size = u.groupBy("book").agg(F.count("*").alias("size"))
    return X.signature_formulas(u, size).select("book", "rank", "grown", "verses", "rest", R(F.col("keyness")).alias("keyness"))


def partners_in_time(spark: SparkSession, d: str) -> DataFrame:
    """Partners of a book by whether they were added before, with or after it (within three months), with the echoes shared."""
    b = table(spark, d, "books").where("name is not null and added is not null").groupBy(F.col("name").alias("book")).agg(F.min("added").alias("added"))
    b = b.select("book", (F.year("added") * 12 + F.month("added")).alias("month"))
    p = FQ.echo_partners(spark, d).join(b, "book", "left").join(b.select(F.col("book").alias("partner"), F.col("month").alias("other")), "partner", "left")
    return p.groupBy("book", J.in_time(F.col("month"), F.col("other"), 3).alias("time")).agg(F.count("*").alias("partners"), F.sum("echoes").alias("echoes"))


def echo_support(spark: SparkSession, d: str) -> DataFrame:
    """For each echo of two verses: in how many of three versions of the text (its units, its words, its lower-case letters) both share a run of three."""
    u = C.units(spark, d)
    runs = X.formulas(u)
    e = X.echoes(X.formula_facts(runs)).where("verses = 2").select("phrase")
    at = X.places(runs, e).groupBy("phrase").agg(F.min("verse_id").alias("verse_a"), F.max("verse_id").alias("verse_b"))
    three = lambda c: F.transform(F.filter(F.sequence(F.lit(1), F.size(c)), lambda i: i <= F.size(c) - 2), lambda i: F.array_join(F.slice(c, i, 3), " "))
    letters = F.split(F.regexp_replace(F.array_join("words", " "), "[^a-z ]", ""), " ")
    v = F.array(*(F.struct(F.lit(n).alias("translation"), three(c).alias("runs")) for n, c in (("units", F.col("units")), ("words", F.col("words")), ("letters", letters))))
    texts = u.where("size(units) > 0").select("verse_id", F.explode(v).alias("x")).select("x.translation", "verse_id", "x.runs")
    return J.support(at.withColumnRenamed("phrase", "echo"), texts)


def echo_idiom(spark: SparkSession, d: str) -> DataFrame:
    """Echoes of two verses by how the versions of the text stand to them: kept by one at most (idiom), by each one asked, or by some."""
    e = echo_support(spark, d)
    kind = F.when(F.col("kept") <= 1, "idiom").when(F.col("kept") == F.col("asked"), "own words").otherwise("some")
    return e.groupBy(kind.alias("class")).agg(F.count("*").alias("echoes"), F.sum("kept").alias("kept"), F.sum("asked").alias("asked"))


def listed_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    """References of a theme to verses that the text lacks, by theme: what a copy of the text has lost."""
    t = table(spark, d, "theme_verse").where("theme_id is not null and verse_id is not null").select(F.col("theme_id").alias("version"), "verse_id").distinct()
    held = C.verses(spark, d).select("verse_id").join(t.select("verse_id").distinct(), "verse_id")
    return J.lost_verses(t, t.join(held, "verse_id").select("version", "verse_id")).groupBy("version").agg(F.count("*").alias("lost"))


def theme_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Each theme's stretch of a book as a prediction, judged by the hottest stretches of passages there."""
    v = C.verses(spark, d).where("book is not null").select("verse_id", "book", "chapter")
    t = table(spark, d, "theme_verse").where("theme_id is not null").select("theme_id", "verse_id").distinct().join(v, "verse_id").groupBy("theme_id", "book").agg(F.min("chapter").alias("first"), F.max("chapter").alias("last"))
    b = C.books(spark, d).select("book", "book_num")
    p = table(spark, d, "passage_ranges").where("passage_id is not null and chapter_start is not null").select("book_num", F.col("chapter_start").alias("first"), F.coalesce("chapter_end", "chapter_start").alias("last")).distinct().join(b, "book_num").select("book", "first", "last")
    return J.predictions(t.withColumn("prediction", F.concat_ws(" / ", "theme_id", "book")), p, 1)


QUERIES = {
    f.__name__: f
    for f in (root_verses, formulas_outside, looked_up, meeting_verses, trimmed_formulas, word_stems, stem_index, latin_lengths, gloss_words, marked_cells, rate_floors, lift_colours, rare_limit, grown_formulas, folded_signatures,
              partners_in_time, echo_support, echo_idiom, listed_elsewhere, theme_predictions)
}

_KW = f"{_T}, kw AS (SELECT DISTINCT lower(surface) AS word FROM tk WHERE surface IS NOT NULL), sm AS ({T.sql_stems('kw', 'kw')})"
_SG = f"""{_WB}, sg AS (SELECT book, root, row_number() OVER (PARTITION BY book ORDER BY keyness DESC, root) AS k FROM wk WHERE keyness > 0),
tw AS (SELECT x.book, x.root AS a, y.root AS b FROM sg x JOIN sg y ON x.book = y.book AND x.k = 1 AND y.k = 2)
"""
# Growth, the SQL's own way: each place to the right (left) is held by all verses with one unit, or growth has ended there.
_GR = f"""{_FR}, fp AS (SELECT book, phrase, n, verse_id, min(i) AS i FROM (SELECT verse_id, book, n, i, array_to_string(list_slice(units, i, i + n - 1), ' ') AS phrase, words[i + n - 1] AS w FROM st) WHERE w NOT IN {sql_list(STOPLIST)} GROUP BY 1, 2, 3, 4),
fg AS (SELECT book, phrase, n, count(*) AS verses FROM fp GROUP BY 1, 2, 3 HAVING count(*) >= 2),
cx AS (SELECT fp.book, fp.phrase, fp.verse_id, list_slice(units, i + fp.n, len(units)) AS r, list_reverse(list_slice(units, 1, i - 1)) AS l FROM fp JOIN fg USING (book, phrase) JOIN un USING (verse_id)),
side AS (SELECT book, phrase, 'r' AS s, k, count(*) AS c, count(DISTINCT r[k]) AS u, min(r[k]) AS w FROM (SELECT *, unnest(range(1, len(r) + 1)) AS k FROM cx) GROUP BY 1, 2, 3, 4
  UNION ALL SELECT book, phrase, 'l', k, count(*), count(DISTINCT l[k]), min(l[k]) FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM cx) GROUP BY 1, 2, 3, 4),
run AS (SELECT side.*, min(CASE WHEN c = verses AND u = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book, phrase, s ORDER BY k) AS go FROM side JOIN fg USING (book, phrase)),
gw AS (SELECT book, phrase, string_agg(w, ' ' ORDER BY k) FILTER (s = 'r') AS r, string_agg(w, ' ' ORDER BY k DESC) FILTER (s = 'l') AS l FROM run WHERE go = 1 GROUP BY 1, 2),
gr AS (SELECT fg.book, fg.phrase, fg.n, verses, coalesce(l || ' ', '') || fg.phrase || coalesce(' ' || r, '') AS grown FROM fg LEFT JOIN gw USING (book, phrase))
"""
_SF = f"""{_GR}, bz AS (SELECT book, count(*) AS size FROM un GROUP BY 1), az AS (SELECT sum(size) AS every FROM bz), ov AS (SELECT phrase, count(DISTINCT verse_id) AS total FROM fr GROUP BY 1),
sc AS (SELECT gr.*, total - verses AS rest, {M.sql_g2('verses', 'total - verses', 'size', 'every - size')} AS key0 FROM gr JOIN ov USING (phrase) JOIN bz USING (book) CROSS JOIN az),
sd2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book, grown ORDER BY round(key0, 6) DESC, n DESC, phrase) AS k FROM sc) WHERE k = 1),
se AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY round(key0, 6) DESC, n DESC, phrase) AS q FROM sd2) WHERE q <= 75),
si AS (SELECT a.book, a.grown FROM se a JOIN se b ON a.book = b.book AND a.grown <> b.grown AND contains(' ' || b.grown || ' ', ' ' || a.grown || ' ') JOIN fp x ON x.book = a.book AND x.phrase = a.phrase
  JOIN fp y ON y.book = b.book AND y.phrase = b.phrase AND y.verse_id = x.verse_id GROUP BY a.book, a.grown, b.grown, a.verses HAVING count(*) >= 0.8 * a.verses),
sj AS (SELECT se.*, CASE WHEN se.grown = se.phrase THEN rest ELSE (SELECT count(DISTINCT verse_id) FROM un WHERE un.book <> se.book AND contains(' ' || array_to_string(units, ' ') || ' ', ' ' || se.grown || ' ')) END AS rest2 FROM se ANTI JOIN si USING (book, grown)),
sk2 AS (SELECT sj.book, grown, verses, rest2, {M.sql_g2('verses', 'rest2', 'size', 'every - size')} AS key FROM sj JOIN bz ON bz.book = sj.book CROSS JOIN az)
"""

_ES = f"""{_FR}, e AS (SELECT phrase AS echo, min(verse_id) AS a, max(verse_id) AS b FROM ep WHERE phrase IN (SELECT phrase FROM ec WHERE verses = 2) GROUP BY 1),
      v AS (SELECT verse_id, unnest([struct_pack(t := 'units', q := units), struct_pack(t := 'words', q := words), struct_pack(t := 'letters', q := string_split(regexp_replace(array_to_string(words, ' '), '[^a-z ]', '', 'g'), ' '))]) AS x FROM un WHERE len(units) > 0),
      g AS (SELECT verse_id, x.t AS t, x.q AS q FROM v), h AS (SELECT DISTINCT verse_id, t, array_to_string(q[i : i + 2], ' ') AS r FROM (SELECT *, unnest(range(1, len(q) - 1)) AS i FROM g)),
      asked AS (SELECT echo, a, b, x.t FROM e JOIN g x ON x.verse_id = a JOIN g y ON y.verse_id = b AND y.t = x.t), kept AS (SELECT DISTINCT echo, x.t FROM e JOIN h x ON x.verse_id = a JOIN h y ON y.verse_id = b AND y.t = x.t AND y.r = x.r)
      SELECT echo, count(kept.t) AS kept, count(*) AS asked FROM asked LEFT JOIN kept USING (echo, t) GROUP BY 1"""

SQL = {
    "root_verses": f"{_T} SELECT root, verse_id, book, chapter, verse, count(*) AS uses FROM tk WHERE root IS NOT NULL GROUP BY ALL",
    "formulas_outside": f"""{_FR}, v AS (SELECT phrase, book, count(DISTINCT verse_id) AS here FROM fr GROUP BY 1, 2) SELECT * FROM (SELECT phrase, book, here, (sum(here) OVER (PARTITION BY phrase) - here)::BIGINT AS outside FROM v) WHERE here >= 2""",
    "looked_up": f"""{_T}, {_BN}, r AS (SELECT DISTINCT id, regexp_extract(reference, {_REF}, 1) AS b, regexp_extract(reference, {_REF}, 2)::INT AS c, regexp_extract(reference, {_REF}, 3)::INT AS s, nullif(regexp_extract(reference, {_REF}, 4), '')::INT AS e FROM theme_verse WHERE regexp_matches(reference, {_REF}))
      SELECT DISTINCT id, verse_id FROM r JOIN bn ON bn.key = regexp_replace(lower(trim(b)), '\\.$', '') JOIN vb ON vb.book = bn.book AND vb.chapter = c AND vb.verse BETWEEN s AND coalesce(e, s)""",
    "meeting_verses": f"""{_SG} SELECT x.book, x.verse_id, count(*) AS meetings FROM tw JOIN tk x ON x.book = tw.book AND x.root = tw.a JOIN tk y ON y.verse_id = x.verse_id AND y.root = tw.b AND abs(x.position - y.position) BETWEEN 1 AND 5 GROUP BY 1, 2""",
    "trimmed_formulas": f"""{_FR}, w AS (SELECT DISTINCT string_split(wording, ' ') AS w FROM fr WHERE n >= 3), e AS (SELECT w, w[1 : greatest(1, coalesce(list_max(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] IN {sql_list(STOPLIST)} THEN 0 ELSE i END)), 1))] AS c FROM w),
      f AS (SELECT w, c, coalesce(list_min(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] IN {sql_list(LEADING)} AND i < len(c) THEN 99 ELSE i END)), 1) AS a FROM e) SELECT array_to_string(c[a : len(c)], ' ') AS formula, count(*) AS wordings FROM f GROUP BY 1""",
    "word_stems": f"{_KW} SELECT word, stem FROM sm",
    "stem_index": f"{_KW} SELECT stem, count(DISTINCT word) AS spellings, count(*) AS uses, count(DISTINCT root) AS roots FROM tk JOIN sm ON word = lower(surface) GROUP BY 1",
    "gloss_words": """SELECT DISTINCT strongs, trim(regexp_replace(regexp_replace(regexp_replace(translit, '\\([^)]*\\)|\\[[^\\]]*\\]|<[^>]*>', ' ', 'g'), '[:;,.]+\\s*$', ''), '\\s+', ' ', 'g')) AS gloss FROM lexicon_forms WHERE translit IS NOT NULL""",
    "marked_cells": """SELECT try_cast(cell AS DOUBLE) IS NOT NULL AS numeric, count(*) AS cells FROM (SELECT unnest([strongs, lemma, reason, added]) AS cell FROM lemma_corrections) WHERE cell IS NOT NULL GROUP BY 1""",
    "rate_floors": f"""{_T}, b AS (SELECT book, sum(len(words))::BIGINT AS words FROM un GROUP BY 1) SELECT book, words, least(5, greatest(3, round_even(words / 1500.0, 0)))::INT AS floor FROM b""",
    "lift_colours": f"""SELECT theme_id, book, chapter, CASE WHEN x >= 0 THEN printf('#ff%02x%02x', f, f) ELSE printf('#%02x%02xff', f, f) END AS colour FROM (SELECT *, round(255 * (1 - abs(x)))::INT AS f FROM (SELECT *, least(1.0, greatest(-1.0, log2(lift) / 2)) AS x FROM ({LINK_SQL["theme_strip"]})))""",
    "rare_limit": f"""{_T}, c AS (SELECT testament AS layer, root, count(*) AS n FROM ct JOIN bk USING (book) WHERE testament IS NOT NULL GROUP BY 1, 2), w AS (SELECT root, sum(n) AS w FROM c GROUP BY 1), x AS (SELECT layer, n, w FROM c JOIN w USING (root)),
      l AS (SELECT DISTINCT least(w, 50) AS lim FROM w UNION SELECT unnest(range(1, 51))), s AS (SELECT lim, layer, sum(CASE WHEN w <= lim THEN n ELSE 0 END) / sum(n)::DOUBLE AS share FROM x CROSS JOIN l GROUP BY 1, 2)
      SELECT lim::BIGINT AS "limit", round(max(share) - min(share), 6) + 0.0 AS gap FROM s WHERE lim >= (SELECT min(w) FROM w) GROUP BY lim ORDER BY max(share) - min(share), lim LIMIT 1""",
    "grown_formulas": f"{_GR} SELECT book, phrase, verses, grown FROM gr",
    "folded_signatures": f"""{_SF} SELECT book, rank::INT AS rank, grown, verses, rest2 AS rest, round(key, 6) + 0.0 AS keyness FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY round(key, 6) DESC, length(grown) DESC, grown) AS rank FROM sk2) WHERE rank <= 25""",
    "partners_in_time": f"""{_FR}, p AS (SELECT a.book, b.book AS partner, count(DISTINCT a.phrase) AS echoes FROM ep a JOIN ep b ON a.phrase = b.phrase AND a.book <> b.book GROUP BY 1, 2), b AS (SELECT name AS book, year(min(added)) * 12 + month(min(added)) AS m FROM books WHERE name IS NOT NULL AND added IS NOT NULL GROUP BY 1)
      SELECT p.book, CASE WHEN x.m IS NULL OR y.m IS NULL THEN '?' WHEN y.m < x.m - 3 THEN 'earlier' WHEN y.m > x.m + 3 THEN 'later' ELSE 'contemporary' END AS time, count(*) AS partners, sum(echoes)::BIGINT AS echoes FROM p LEFT JOIN b x ON x.book = p.book LEFT JOIN b y ON y.book = partner GROUP BY 1, 2""",
    "echo_support": _ES,
    "echo_idiom": f"""SELECT CASE WHEN kept <= 1 THEN 'idiom' WHEN kept = asked THEN 'own words' ELSE 'some' END AS class, count(*) AS echoes, sum(kept)::BIGINT AS kept, sum(asked)::BIGINT AS asked FROM ({_ES}) GROUP BY 1""",
    "listed_elsewhere": f"{_T} SELECT theme_id AS version, count(DISTINCT verse_id) AS lost FROM theme_verse WHERE theme_id IS NOT NULL AND verse_id IS NOT NULL AND verse_id NOT IN (SELECT verse_id FROM vb) GROUP BY 1",
    "theme_predictions": f"""{_T}, t AS (SELECT theme_id || ' / ' || vb.book AS prediction, vb.book, min(chapter) AS a, max(chapter) AS z FROM (SELECT DISTINCT theme_id, verse_id FROM theme_verse WHERE theme_id IS NOT NULL) x JOIN vb USING (verse_id) WHERE vb.book IS NOT NULL GROUP BY theme_id, vb.book),
      p AS (SELECT bk.book, chapter_start AS f, coalesce(chapter_end, chapter_start) AS l FROM passage_ranges JOIN bk USING (book_num) WHERE passage_id IS NOT NULL AND chapter_start IS NOT NULL)
      SELECT prediction, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.book = t.book AND f <= z AND l >= a) THEN 'hit' WHEN EXISTS (SELECT 1 FROM p WHERE p.book = t.book AND f <= z + 1 AND l >= a - 1) THEN 'near' ELSE 'miss' END AS judgement FROM t""",
    # of queries of other modules, by common subsequences and lists
    "verdicts": f"""{_RN}, cu AS (SELECT verse_id, list_filter(units, lambda w: w NOT IN {sql_list(STOPLIST)}) AS u FROM un), x AS (SELECT verse_a, verse_b, hits, a.u AS ua, b.u AS ub FROM rp JOIN cu a ON a.verse_id = verse_a JOIN cu b ON b.verse_id = verse_b WHERE book_a <> book_b),
      y AS (SELECT *, {Q.sql_lcs("ua", "ub")} AS k, least(len(ua), len(ub)) AS n, len(list_distinct(list_intersect(ua, ub))) AS bt FROM x)
      SELECT verse_a, verse_b, hits, CASE WHEN n = 0 THEN 'departs' WHEN k = n AND len(ua) = len(ub) THEN 'whole' WHEN k = n - 1 AND n >= 3 THEN 'one word changed' WHEN k = n THEN 'held inside'
        WHEN bt >= 2 AND k < bt THEN 'same words, other order (' || bt || ' roots)' WHEN k >= 3 THEN 'formula' ELSE 'departs' END AS verdict FROM y""",
    "part_likeness": f"""{_T}, x AS (SELECT verse_id, position, morph, CASE WHEN regexp_matches(morph, '^H[A-Z]') THEN substr(morph, 2, 1) ELSE substr(morph, 1, 1) END AS x FROM tk WHERE morph IS NOT NULL),
      p AS (SELECT verse_id, position, CASE WHEN morph = 'PREP' THEN 'preposition' WHEN morph = 'CONJ' THEN 'conjunction' ELSE {_PS} END AS p FROM x), v AS (SELECT verse_id, list(p ORDER BY position) AS p FROM p WHERE p IS NOT NULL GROUP BY 1 HAVING count(*) >= 4),
      h AS (SELECT verse_id, p[1 : len(p) // 2] AS a, p[len(p) // 2 + 1 : len(p)] AS b FROM v) SELECT verse_id, round({Q.sql_lcs("a", "b")} / greatest(len(a), len(b))::DOUBLE, 6) + 0.0 AS likeness FROM h""",
    "seam_check": f"""WITH s AS ({STYLE_SQL["chapter_shifts"]}), t AS (SELECT theme_id, book, min(chapter) AS a, max(chapter) AS b FROM ({LINK_SQL["theme_strip"]}) GROUP BY 1, 2), e AS (SELECT DISTINCT book, unnest([a, b]) AS chapter FROM t)
      SELECT e.book, e.chapter, round(((SELECT count(*) FROM s y WHERE y.book = e.book AND y.distance < s.distance) + 0.5 * (SELECT count(*) FROM s y WHERE y.book = e.book AND y.distance = s.distance)) / (SELECT count(*) FROM s y WHERE y.book = e.book), 6) + 0.0 AS percentile
      FROM e JOIN s ON s.book = e.book AND s.chapter = e.chapter""",
    "strip_variety": f"""{_ST}, cw AS (SELECT v.book, v.i, list(root ORDER BY position) AS q FROM v JOIN ct USING (verse_id) GROUP BY 1, 2), wq AS (SELECT book, start, flatten(list(q ORDER BY i)) AS q FROM wk0 LEFT JOIN cw USING (book) WHERE i BETWEEN start AND start + 9 GROUP BY 1, 2),
      ww AS (SELECT book, start, list_transform(range(1, greatest(2, len(q) - 48)), lambda k: len(list_distinct(q[k : k + 49])) / least(50, len(q))::DOUBLE) AS r FROM wq)
      SELECT book, start, round(coalesce(list_avg(r), 0), 6) + 0.0 AS variety FROM wk0 LEFT JOIN ww USING (book, start)""",
    "belonging": f"""WITH c AS ({MINING_SQL["companions"]}), l AS (SELECT vec_id AS id, min(label) AS label FROM embeddings GROUP BY 1), n AS (SELECT label, count(*) AS size, sum(count(*)) OVER () AS every FROM l GROUP BY 1)
      SELECT x.label, count(*) AS companions, count(*) FILTER (x.label = y.label) AS own, round(any_value(size) / any_value(every)::DOUBLE, 6) + 0.0 AS expected FROM c JOIN l x ON x.id = a JOIN l y ON y.id = b JOIN n ON n.label = x.label GROUP BY 1""",
}
