"""Projections, predicates and smaller operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillmark.functions import measures as M, text as T
from quillmark.operators import corpus as C, facts as X, links as L, tagging as G
from quillmark.plans.fact_queries import _CC, _FR, _T, _WB, word_book
from quillmark.plans.link_queries import SQL as LINK_SQL, _names, compare_chapters
from quillmark.sources.tables import table

R = M.rounded
_TIME = "yyyy-MM-dd HH:mm:ss"


def document_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of every document by language: how many, and how many different spellings."""
    t = table(spark, d, "documents").where("text is not null").select("lang", F.explode(T.words("text")).alias("w"))
    n = t.groupBy("lang", "w").agg(F.count("*").alias("n"))
    return n.groupBy("lang").agg(F.sum("n").alias("words"), F.count("*").alias("spellings"))


def verse_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the verses' texts in lower case, with verses and uses."""
    t = C.verse_texts(spark, d).where("text is not null").select("verse_id", F.explode(T.tokenise("text")).alias("word"))
    return t.groupBy("word", "verse_id").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("uses"), F.count("*").alias("verses"))


def proper_names(spark: SparkSession, d: str) -> DataFrame:
    """Words that stand inside a verse with a capital more often than without."""
    t = C.verse_texts(spark, d).where("text is not null").select(F.posexplode(T.words("text")).alias("at", "w")).where("at > 0")
    n = t.groupBy(F.lower("w").alias("word")).agg(F.count_if(F.col("w").rlike(r"^\p{Lu}")).alias("capital"), F.count("*").alias("uses"))
    return n.where("capital * 2 > uses")


def phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    """Uses of a few set phrases in each book."""
    v = C.units(spark, d).select("book", F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")).alias("s"))
    phrases = F.array(F.lit("of the"), F.lit("and the"), F.lit("in the"), F.lit("shall not"), F.lit("unto him"))
    x = v.select("book", "s", F.explode(phrases).alias("phrase"))
    n = F.size(F.split("s", F.concat(F.lit(" "), F.replace("phrase", F.lit(" "), F.lit("  ")), F.lit(" ")))) - 1
    return x.groupBy("book", "phrase").agg(F.sum(n.cast("long")).alias("uses")).where("uses > 0")


def verse_language(spark: SparkSession, d: str) -> DataFrame:
    """Language of each verse by the majority of its placed tags, beside the one stated."""
    t = C.tokens(spark, d).where(F.col("strongs").rlike(r"^[HG]\d"))
    n = t.groupBy("verse_id", "language").agg(F.count_if(F.col("strongs").startswith("H")).alias("hebrew"), F.count_if(F.col("strongs").startswith("G")).alias("greek"))
    return n.select("verse_id", F.when(F.col("hebrew") >= F.col("greek"), "Hebrew").otherwise("Greek").alias("voted"), F.col("language").alias("stated"))


def phrase_units(spark: SparkSession, d: str) -> DataFrame:
    """Unit of each occurrence: the number of a tagged content word, otherwise the spelling; counted."""
    t = C.tokens(spark, d)
    unit = F.when(F.col("root").rlike(C.ROOT) & ~F.col("is_stop"), F.col("root")).otherwise(F.col("surface"))
    return t.select(unit.alias("unit")).where("unit is not null").groupBy("unit").agg(F.count("*").alias("uses"))


def tag_marks(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences by how they are tagged, and the numbers of each kind without marks and added letters."""
    s = F.col("strongs")
    kind = F.when(s.isNull() | (s == ""), "none").when(s.startswith("~"), "inferred").when(s.startswith("="), "absorbed").when(s.contains("+"), "joined").otherwise("placed")
    return C.tokens(spark, d).select(kind.alias("kind"), T.simple_strongs("strongs").alias("number")).groupBy("kind").agg(F.count("*").alias("uses"), F.count_distinct("number").alias("numbers"))


def inferred_tags(spark: SparkSession, d: str) -> DataFrame:
    return G.usual_number(C.tokens(spark, d))


def company_tags(spark: SparkSession, d: str) -> DataFrame:
    return G.usual_company(C.tokens(spark, d))


def word_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """How often each two words follow each other in a verse."""
    w = Window.partitionBy("verse_id").orderBy("position")
    t = C.tokens(spark, d).where("surface is not null").select("verse_id", F.col("surface").alias("word"), F.lead("surface").over(w).alias("next"))
    return t.where("next is not null").groupBy("word", "next").agg(F.count("*").alias("uses"))


def parsed_references(spark: SparkSession, d: str) -> DataFrame:
    """Written references of the themes, read, with their book's name."""
    t = table(spark, d, "theme_verse").select("id", T.reference("reference").alias("r")).distinct()
    r = t.select("id", L.book_key("r.book").alias("key"), "r.chapter", "r.verse_start", "r.verse_end")
    return r.join(_names(spark, d).select("key", "book"), "key", "left").select("id", "book", "chapter", "verse_start", "verse_end")


def theme_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources cited by each theme, from their JSON."""
    t = table(spark, d, "theme_verse").select("id", "theme_id", F.explode(F.from_json("source_refs", "array<string>")).alias("source")).distinct()
    return t.groupBy("theme_id").agg(F.count("*").alias("citations"), F.count_distinct("source").alias("sources"))


def theme_class(spark: SparkSession, d: str) -> DataFrame:
    """Class of each theme row: excluded before unexplained before borderline before core."""
    role = F.when(F.col("role") == "excluded", "excluded").when(F.coalesce(F.trim("reason"), F.lit("")) == "", "unexplained").when(F.col("role") == "borderline", "borderline").otherwise("core")
    return table(spark, d, "theme_verse").select("id", "theme_id", role.alias("class")).distinct().groupBy("theme_id", "class").agg(F.count("*").alias("n"))


def parts_of_speech(spark: SparkSession, d: str) -> DataFrame:
    return C.tokens(spark, d).select("book", F.coalesce(T.part_of_speech("morph"), F.lit("none")).alias("part")).groupBy("book", "part").agg(F.count("*").alias("uses"))


def verb_table(spark: SparkSession, d: str) -> DataFrame:
    """Moods and forms of verbs by book and chapter."""
    m = F.coalesce(T.hebrew_morph("morph")["form"], T.greek_morph("morph")["mood"])
    return C.tokens(spark, d).where(F.col("morph").rlike("^H?V")).groupBy("book", "chapter", m.alias("form")).agg(F.count("*").alias("uses"))


def packed_codes(spark: SparkSession, d: str) -> DataFrame:
    """Counts by (chapter, verse, position) packed in one number and unpacked again."""
    bits = (("chapter", 16), ("verse", 16), ("position", 16))
    t = C.tokens(spark, d).select(T.pack(*bits).alias("code")).groupBy("code").agg(F.count("*").alias("uses"))
    return t.select("code", *T.unpack(F.col("code"), *bits), "uses")


def latin_forms(spark: SparkSession, d: str) -> DataFrame:
    """Lexicon words in Latin letters."""
    return table(spark, d, "lexicon_forms").where("script is not null and script <> ''").select("strongs", "script").distinct().select("strongs", "script", T.latin("script").alias("latin"))


def text_checksums(spark: SparkSession, d: str) -> DataFrame:
    """A sum over the digests of a book's verses: equal texts in any order of rows give equal sums."""
    one = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("verse_id").cast("string"), F.coalesce("text", F.lit("")))), 1, 8), 16, 10).cast("long")
    return C.verse_texts(spark, d).where("book is not null").groupBy("book").agg(F.sum(one).alias("checksum"), F.count("*").alias("verses"))


def root_equivalents(spark: SparkSession, d: str) -> DataFrame:
    """Roots that share a lemma no third root has."""
    r = table(spark, d, "roots").where("root is not null and lemma is not null").select("root", "lemma").distinct()
    g = r.groupBy("lemma").agg(F.count("*").alias("n"), F.min("root").alias("root_a"), F.max("root").alias("root_b"))
    return g.where("n = 2").select("root_a", "root_b", "lemma")


def unique_spellings(spark: SparkSession, d: str) -> DataFrame:
    return C.content(spark, d).where("surface is not null").groupBy("root").agg(F.count_distinct(T.fold("surface")).alias("spellings"))


def home_words(spark: SparkSession, d: str) -> DataFrame:
    """The book that uses each root most, its share, and the second; roots in two books or more."""
    b = X.book_counts(X.chapter_counts(C.content(spark, d))).select("book", "root", "weight")
    top = X.top_k(b, ["root"], [F.desc("weight"), F.col("book")], 2)
    total = b.groupBy("root").agg(F.sum("weight").alias("total"), F.count("*").alias("books")).where("books >= 2")
    p = top.groupBy("root").agg(F.max(F.when(F.col("rank") == 1, F.col("book"))).alias("home"), F.max(F.when(F.col("rank") == 1, F.col("weight"))).alias("w"), F.max(F.when(F.col("rank") == 2, F.col("book"))).alias("second"))
    return p.join(total, "root").select("root", "home", "second", R(F.col("w") / F.col("total")).alias("share"))


def inverse_frequency(spark: SparkSession, d: str) -> DataFrame:
    """ln(verses / verses with the root)."""
    r = C.content(spark, d).select("verse_id", "root").distinct()
    df = r.groupBy("root").agg(F.count("*").alias("df")).withColumn("n", r.agg(F.count_distinct("verse_id")).scalar())
    return df.select("root", R(F.log(F.col("n") / F.col("df"))).alias("idf"))


def around_verses(spark: SparkSession, d: str) -> DataFrame:
    """The verses before and after each verse in its chapter, 0 where there is none."""
    w = Window.partitionBy("book", "chapter").orderBy("verse", "verse_id")
    return C.verses(spark, d).where("book is not null").select("verse_id", F.coalesce(F.lag("verse_id").over(w), F.lit(0)).alias("before"), F.coalesce(F.lead("verse_id").over(w), F.lit(0)).alias("after"))


def sampled_verses(spark: SparkSession, d: str) -> DataFrame:
    """A hundred verses by the order of a seeded digest: the same on every run and cluster."""
    return C.verses(spark, d).select("verse_id").orderBy(F.md5(F.concat(F.col("verse_id").cast("string"), F.lit(":7"))), "verse_id").limit(100)


def merged_references(spark: SparkSession, d: str) -> DataFrame:
    """References between the same two places as one row: best score, number of rows and first id."""
    r = table(spark, d, "cross_references").where("from_reference is not null and to_reference is not null").select("id", "from_reference", "to_reference", "relevance_score").distinct()
    return r.groupBy("from_reference", "to_reference").agg(F.max("relevance_score").alias("best"), F.count_distinct("id").alias("n"), F.min("id").alias("first_id"))


def folded_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Formulas that stand inside a longer formula of just the same verses."""
    r = X.formulas(C.units(spark, d))
    same = F.struct(F.count("*").alias("verses"), F.sum(F.xxhash64("verse_id").bitwiseAND(F.lit((1 << 40) - 1))).alias("s"), F.bit_xor(F.xxhash64("verse_id", F.lit(1))).alias("x"))  # a digest of the set of verses, whatever its size
    at = r.select("phrase", "verse_id", "n").distinct().groupBy("phrase", "n").agg(same.alias("at")).where("at.verses >= 2")
    a, b = at.select("at", "phrase", "n"), at.select("at", F.col("phrase").alias("longer"), F.col("n").alias("m"))
    inside = F.instr(F.concat(F.lit(" "), F.col("longer"), F.lit(" ")), F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))) > 0
    return a.join(b, "at").where("n < m").where(inside).select("phrase").distinct()


def load_changes(spark: SparkSession, d: str) -> DataFrame:
    """Verses loaded more than once: first and last load, and whether the text changed between them."""
    v = table(spark, d, "verses").where("verse_id is not null and loaded is not null")
    g = v.groupBy("verse_id").agg(F.count_distinct("loaded").alias("loads"), F.min("loaded").alias("first"), F.max("loaded").alias("last"), F.min_by(F.coalesce("text", F.lit("")), "loaded").alias("a"), F.max_by(F.coalesce("text", F.lit("")), "loaded").alias("b"))
    return g.where("loads > 1").select("verse_id", "loads", F.date_format("first", _TIME).alias("first"), F.date_format("last", _TIME).alias("last"), (F.col("a") != F.col("b")).alias("changed"))


def order_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of chapters whose best partner chapters in one other book don't step back, three chapters or more."""
    c = compare_chapters(spark, d)
    both = c.select("book_a", "chapter_a", "book_b", "chapter_b", "shared").unionByName(c.select(F.col("book_b").alias("book_a"), F.col("chapter_b").alias("chapter_a"), F.col("book_a").alias("book_b"), F.col("chapter_a").alias("chapter_b"), "shared"))
    best = X.top_k(both, ["book_a", "chapter_a", "book_b"], [F.desc("shared"), F.col("chapter_b")], 1)
    w = Window.partitionBy("book_a", "book_b").orderBy("chapter_a")
    rows = best.withColumn("new", F.coalesce(F.col("chapter_b") < F.lag("chapter_b").over(w), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    return rows.groupBy("book_a", "book_b", "run").agg(F.count("*").alias("chapters"), F.min("chapter_a").alias("first"), F.max("chapter_a").alias("last")).where("chapters >= 3").drop("run")


def chapter_runs(spark: SparkSession, d: str) -> DataFrame:
    """From each chapter the shortest run of chapters with 400 words or more, of at most 625: text samples of one size."""
    v = C.units(spark, d).groupBy("book", "chapter").agg(F.sum(F.size("words")).cast("long").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("book").orderBy("chapter"))
    c = v.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("w"))
    ends = c.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("upto", "chapter"))).alias("ends"))  # a book's chapters bound it
    end = F.get(F.filter("ends", lambda e: e["upto"] - F.col("before") >= 400), F.lit(0))
    out = c.join(ends, "book").select("book", F.col("chapter").alias("first"), end["chapter"].alias("last"), (end["upto"] - F.col("before")).alias("words"))
    return out.where("words <= 625")


def crux_density(spark: SparkSession, d: str) -> DataFrame:
    """Each book's share of the 500 highest keyness values against its share of all rows."""
    k = word_book(spark, d).where("keyness > 0").select("book", "root", "keyness")
    top = k.orderBy(F.desc("keyness"), "book", "root").limit(500).groupBy(F.col("book").alias("b")).agg(F.count("*").alias("top"))
    g = k.groupBy("book").agg(F.count("*").alias("n")).join(top, F.col("book") == F.col("b"), "left").select("book", "n", F.coalesce("top", F.lit(0)).alias("top"))
    g = g.withColumn("all", g.agg(F.sum("n")).scalar())
    return g.select("book", "top", R((F.col("top") / F.least(F.lit(500), F.col("all"))) / (F.col("n") / F.col("all"))).alias("density"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """The signature words as cells (page, row, column, value, number), the form in which results are stored."""
    t = X.top_k(word_book(spark, d).where("keyness > 0"), ["book"], [F.desc("keyness"), F.col("root")], 25)
    x = t.select("book", "rank", F.explode(F.array(F.struct(F.lit("root").alias("c"), F.col("root").alias("v")), F.struct(F.lit("weight").alias("c"), F.col("weight").cast("string").alias("v")), F.struct(F.lit("chapters").alias("c"), F.col("chapters").cast("string").alias("v")))).alias("x"))
    return x.select(F.col("book").alias("page"), F.col("rank").alias("row"), F.col("x.c").alias("column_name"), F.col("x.v").alias("value"), F.col("x.v").try_cast("double").alias("number"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type: tumbling windows."""
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), R(F.sum("value"), 4).alias("value")).select(F.date_format("w.start", _TIME).alias("start"), "event_type", "n", "value")


def event_slides(spark: SparkSession, d: str) -> DataFrame:
    """Events in windows of a day that begin every six hours."""
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", _TIME).alias("start"), "n")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user: events less than half an hour apart."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.date_format("w.start", _TIME).alias("start"), "n")


_WORDS = r"regexp_extract_all(translate(text, '’‘ʼ`–—', '''''''''--'), '([\p{L}\x{300}-\x{36F}\x{591}-\x{5BD}\x{5BF}-\x{5C7}]+(?:[''-][\p{L}\x{300}-\x{36F}\x{591}-\x{5BD}\x{5BF}-\x{5C7}]+)*)', 1)"
_BN = "bn AS (SELECT key, min(name) AS book FROM (SELECT name, unnest([lower(name), lower(abbreviation)]) AS key FROM books WHERE name IS NOT NULL) WHERE key IS NOT NULL GROUP BY 1)"
_REF = r"'^\s*([1-3]?\s?[^\d]+?)\.?\s+(\d+)\s*[:.]\s*(\d+)(?:\s*[-–]\s*(\d+))?\s*$'"
_HF = "CASE " + " ".join(f"WHEN f = '{k}' THEN '{v}'" for k, v in T.HEBREW_FORMS.items()) + " END"
_GM = "CASE " + " ".join(f"WHEN g = '{k}' THEN '{v}'" for k, v in T.GREEK_MOOD.items()) + " END"
_PS = "CASE " + " ".join(f"WHEN x = '{k}' THEN '{v}'" for k, v in T.PARTS.items()) + " END"

QUERIES = {
    f.__name__: f
    for f in (document_words, verse_words, proper_names, phrase_counts, verse_language, phrase_units, tag_marks, inferred_tags, company_tags, word_neighbours, parsed_references, theme_sources, theme_class, parts_of_speech, verb_table, packed_codes,
              latin_forms, text_checksums, root_equivalents, unique_spellings, home_words, inverse_frequency, around_verses, sampled_verses, merged_references, folded_formulas, load_changes, order_runs, chapter_runs, crux_density, cells, event_windows, event_slides, event_sessions)
}

SQL = {
    "document_words": f"SELECT lang, count(*) AS words, count(DISTINCT w) AS spellings FROM (SELECT lang, unnest({_WORDS}) AS w FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "verse_words": f"""{_T} SELECT CASE WHEN w IN ('LORD', 'GOD', 'JEHOVAH', 'JAH') THEN w ELSE lower(w) END AS word, count(*) AS uses, count(DISTINCT verse_id) AS verses FROM (SELECT verse_id, unnest({_WORDS}) AS w FROM vt WHERE text IS NOT NULL) GROUP BY 1""",
    "proper_names": f"""{_T}, l AS (SELECT {_WORDS} AS q FROM vt WHERE text IS NOT NULL), w AS (SELECT unnest(list_slice(q, 2, len(q))) AS w FROM l WHERE len(q) > 1)
      SELECT lower(w) AS word, count(*) FILTER (regexp_matches(w, '^\\p{{Lu}}')) AS capital, count(*) AS uses FROM w GROUP BY 1 HAVING count(*) FILTER (regexp_matches(w, '^\\p{{Lu}}')) * 2 > count(*)""",
    "phrase_counts": f"""{_T}, p AS (SELECT unnest(['of the', 'and the', 'in the', 'shall not', 'unto him']) AS phrase), x AS (SELECT book, words, unnest(range(1, len(words))) AS i FROM un WHERE len(words) >= 2)
      SELECT book, phrase, count(*) AS uses FROM x JOIN p ON words[i] || ' ' || words[i + 1] = phrase GROUP BY 1, 2""",
    "verse_language": f"""{_T} SELECT verse_id, CASE WHEN count(*) FILTER (strongs LIKE 'H%') >= count(*) FILTER (strongs LIKE 'G%') THEN 'Hebrew' ELSE 'Greek' END AS voted, language AS stated FROM tk WHERE regexp_matches(strongs, '^[HG]\\d') GROUP BY verse_id, language""",
    "phrase_units": f"{_T} SELECT CASE WHEN regexp_matches(root, '^[HG]\\d+$') AND NOT is_stop THEN root ELSE surface END AS unit, count(*) AS uses FROM tk GROUP BY 1 HAVING unit IS NOT NULL",
    "tag_marks": f"""{_T} SELECT CASE WHEN strongs IS NULL OR strongs = '' THEN 'none' WHEN strongs LIKE '~%' THEN 'inferred' WHEN strongs LIKE '=%' THEN 'absorbed' WHEN strongs LIKE '%+%' THEN 'joined' ELSE 'placed' END AS kind, count(*) AS uses,
      count(DISTINCT nullif(regexp_replace(regexp_extract(strongs, '([HG]\\d+)', 1), '^([HG])0+(\\d)', '\\1\\2'), '')) AS numbers FROM tk GROUP BY 1""",
    "inferred_tags": f"""{_T}, c AS (SELECT surface, book, substr(root, 1, 1) AS l, root FROM ct WHERE surface IS NOT NULL AND regexp_matches(root, '^[HG]\\d+$')), n AS (SELECT surface, book, root, count(*) AS n FROM c GROUP BY 1, 2, 3),
      r AS (SELECT surface, book, root, n, sum(n) OVER (PARTITION BY surface, book) AS total, row_number() OVER (PARTITION BY surface, book ORDER BY n DESC, root) AS k FROM n)
      SELECT surface, book, root, n AS uses, total::BIGINT AS total FROM r WHERE k = 1 AND total >= 3 AND n * 2 >= total""",
    "company_tags": f"""{_T}, x AS (SELECT verse_id, position, surface, is_stop, root, regexp_matches(coalesce(root, ''), '^[HG]\\d+$') AND NOT is_stop AS tagged FROM tk WHERE surface IS NOT NULL),
      y AS (SELECT surface, is_stop, tagged, CASE WHEN lag(tagged) OVER w THEN lag(root) OVER w END AS before, CASE WHEN lead(tagged) OVER w THEN lead(root) OVER w END AS after FROM x WINDOW w AS (PARTITION BY verse_id ORDER BY position)),
      z AS (SELECT surface, before, after FROM y WHERE NOT tagged AND NOT is_stop), t AS (SELECT surface, count(*) AS total FROM z GROUP BY 1 HAVING count(*) >= 5),
      m AS (SELECT surface, mate, count(*) AS n FROM (SELECT surface, before AS mate FROM z WHERE before IS NOT NULL UNION ALL SELECT surface, after FROM z WHERE after IS NOT NULL AND after IS DISTINCT FROM before) GROUP BY 1, 2),
      b AS (SELECT surface, mate, n, total, row_number() OVER (PARTITION BY surface ORDER BY n DESC, mate) AS k FROM m JOIN t USING (surface)) SELECT surface, mate, n AS uses, total FROM b WHERE k = 1 AND n * 10 >= total * 6""",
    "word_neighbours": f"{_T} SELECT word, next, count(*) AS uses FROM (SELECT surface AS word, lead(surface) OVER (PARTITION BY verse_id ORDER BY position) AS next FROM tk WHERE surface IS NOT NULL) WHERE next IS NOT NULL GROUP BY 1, 2",
    "parsed_references": f"""WITH {_BN}, r AS (SELECT DISTINCT id, reference, regexp_matches(reference, {_REF}) AS ok FROM theme_verse),
      s AS (SELECT id, CASE WHEN ok THEN regexp_replace(lower(trim(regexp_extract(reference, {_REF}, 1))), '\\.$', '') END AS key, CASE WHEN ok THEN nullif(regexp_extract(reference, {_REF}, 2), '')::INT END AS chapter, CASE WHEN ok THEN nullif(regexp_extract(reference, {_REF}, 3), '')::INT END AS verse_start,
        CASE WHEN ok THEN coalesce(nullif(regexp_extract(reference, {_REF}, 4), ''), nullif(regexp_extract(reference, {_REF}, 3), ''))::INT END AS verse_end FROM r)
      SELECT id, book, chapter, verse_start, verse_end FROM s LEFT JOIN bn USING (key)""",
    "theme_sources": """SELECT theme_id, count(*) AS citations, count(DISTINCT source) AS sources FROM (SELECT DISTINCT id, theme_id, unnest(from_json(source_refs, '["VARCHAR"]')) AS source FROM theme_verse) GROUP BY 1""",
    "theme_class": """SELECT theme_id, class, count(*) AS n FROM (SELECT DISTINCT id, theme_id, CASE WHEN role = 'excluded' THEN 'excluded' WHEN coalesce(trim(reason), '') = '' THEN 'unexplained' WHEN role = 'borderline' THEN 'borderline' ELSE 'core' END AS class FROM theme_verse) GROUP BY 1, 2""",
    "parts_of_speech": f"""{_T}, x AS (SELECT book, morph, CASE WHEN regexp_matches(morph, '^H[A-Z]') THEN substr(morph, 2, 1) ELSE substr(morph, 1, 1) END AS x FROM tk)
      SELECT book, coalesce(CASE WHEN morph = 'PREP' THEN 'preposition' WHEN morph = 'CONJ' THEN 'conjunction' ELSE {_PS} END, 'none') AS part, count(*) AS uses FROM x GROUP BY 1, 2""",
    "verb_table": f"""{_T}, x AS (SELECT book, chapter, regexp_extract(morph, '^H?V[a-zA-Z]([a-z])', 1) AS f, regexp_extract(morph, '^V-2?[A-Z][A-Z]([A-Z])', 1) AS g FROM tk WHERE regexp_matches(morph, '^H?V'))
      SELECT book, chapter, coalesce({_HF}, {_GM}) AS form, count(*) AS uses FROM x GROUP BY 1, 2, 3""",
    "packed_codes": f"{_T} SELECT (chapter::BIGINT << 32) + (verse::BIGINT << 16) + position AS code, chapter::BIGINT AS chapter, verse::BIGINT AS verse, position::BIGINT AS position, count(*) AS uses FROM tk GROUP BY 1, 2, 3, 4",
    "text_checksums": f"{_T} SELECT book, sum(('0x' || substr(md5(verse_id::VARCHAR || '|' || coalesce(text, '')), 1, 8))::BIGINT)::BIGINT AS checksum, count(*) AS verses FROM vt WHERE book IS NOT NULL GROUP BY 1",
    "root_equivalents": "SELECT min(root) AS root_a, max(root) AS root_b, lemma FROM (SELECT DISTINCT root, lemma FROM roots WHERE root IS NOT NULL AND lemma IS NOT NULL) GROUP BY lemma HAVING count(*) = 2",
    "unique_spellings": f"{_T} SELECT root, count(DISTINCT lower(replace(replace(surface, '''', ''), '-', ''))) AS spellings FROM ct WHERE surface IS NOT NULL GROUP BY 1",
    "home_words": f"""{_CC}, r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY weight DESC, book) AS k, sum(weight) OVER (PARTITION BY root) AS total, count(*) OVER (PARTITION BY root) AS books FROM bc)
      SELECT root, max(book) FILTER (k = 1) AS home, max(book) FILTER (k = 2) AS second, round(max(weight) FILTER (k = 1) / max(total)::DOUBLE, 6) + 0.0 AS share FROM r WHERE books >= 2 GROUP BY 1""",
    "inverse_frequency": f"{_T} SELECT root, round(ln((SELECT count(DISTINCT verse_id) FROM ct) / count(DISTINCT verse_id)::DOUBLE), 6) + 0.0 AS idf FROM ct GROUP BY 1",
    "around_verses": f"{_T} SELECT verse_id, coalesce(lag(verse_id) OVER w, 0) AS before, coalesce(lead(verse_id) OVER w, 0) AS after FROM vb WHERE book IS NOT NULL WINDOW w AS (PARTITION BY book, chapter ORDER BY verse, verse_id)",
    "sampled_verses": f"{_T} SELECT verse_id FROM vb ORDER BY md5(verse_id::VARCHAR || ':7'), verse_id LIMIT 100",
    "merged_references": "SELECT from_reference, to_reference, max(relevance_score) AS best, count(DISTINCT id) AS n, min(id) AS first_id FROM cross_references WHERE from_reference IS NOT NULL AND to_reference IS NOT NULL GROUP BY 1, 2",
    "folded_formulas": f"""{_FR}, a AS (SELECT phrase, n, list_sort(list(DISTINCT verse_id)) AS at_ FROM fr GROUP BY 1, 2 HAVING count(DISTINCT verse_id) >= 2)
      SELECT DISTINCT x.phrase FROM a x JOIN a y ON x.at_ = y.at_ AND x.n < y.n WHERE contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')""",
    "load_changes": """SELECT verse_id, count(DISTINCT loaded) AS loads, strftime(min(loaded), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(loaded), '%Y-%m-%d %H:%M:%S') AS last, arg_min(coalesce(text, ''), loaded) <> arg_max(coalesce(text, ''), loaded) AS changed FROM verses WHERE verse_id IS NOT NULL AND loaded IS NOT NULL GROUP BY 1 HAVING count(DISTINCT loaded) > 1""",
    "order_runs": f"""{LINK_SQL["compare_chapters"].replace('SELECT x.book AS book_a', ', cmp AS (SELECT x.book AS book_a', 1)}),
      bo AS (SELECT book_a, chapter_a, book_b, chapter_b, shared FROM cmp UNION ALL SELECT book_b, chapter_b, book_a, chapter_a, shared FROM cmp),
      be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_a, chapter_a, book_b ORDER BY shared DESC, chapter_b) AS k FROM bo) WHERE k = 1),
      nw AS (SELECT *, CASE WHEN chapter_b >= lag(chapter_b) OVER w THEN 0 ELSE 1 END AS new FROM be WINDOW w AS (PARTITION BY book_a, book_b ORDER BY chapter_a)),
      rn AS (SELECT *, sum(new) OVER (PARTITION BY book_a, book_b ORDER BY chapter_a) AS run FROM nw)
      SELECT book_a, book_b, count(*) AS chapters, min(chapter_a) AS first, max(chapter_a) AS last FROM rn GROUP BY book_a, book_b, run HAVING count(*) >= 3""",
    "chapter_runs": f"""{_T}, v AS (SELECT book, chapter, sum(len(words)) AS w FROM un GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY book ORDER BY chapter) AS upto FROM v),
      n AS (SELECT a.book, a.chapter AS first, min(b.chapter) AS last, min(b.upto - a.upto + a.w)::BIGINT AS words FROM c a JOIN c b ON a.book = b.book AND b.chapter >= a.chapter AND b.upto - a.upto + a.w >= 400 GROUP BY 1, 2) SELECT * FROM n WHERE words <= 625""",
    "crux_density": f"""{_WB}, k AS (SELECT book, row_number() OVER (ORDER BY keyness DESC, book, root) AS r FROM wk WHERE keyness > 0), g AS (SELECT book, count(*) FILTER (r <= 500) AS top, count(*) AS n FROM k GROUP BY 1)
      SELECT book, top, round((top / least(500, (SELECT sum(n) FROM g))::DOUBLE) / (n / (SELECT sum(n) FROM g)::DOUBLE), 6) + 0.0 AS density FROM g""",
    "cells": f"""{_WB}, t AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY keyness DESC, root) AS k FROM wk WHERE keyness > 0), c AS (SELECT book, k, unnest(['root', 'weight', 'chapters']) AS column_name, unnest([root, weight::VARCHAR, chapters::VARCHAR]) AS value FROM t WHERE k <= 25)
      SELECT book AS page, k::INT AS row, column_name, value, try_cast(value AS DOUBLE) AS number FROM c""",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS value FROM events GROUP BY 1, 2",
    "event_slides": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1",
    "event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
