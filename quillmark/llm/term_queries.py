"""Queries on terms, pairs and sets of terms: problems 1, 4, 6 and 7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillmark.llm.distinctive import distinctive_terms
from quillmark.llm.frequency import ngram_counts
from quillmark.llm.pairs import co_occurring
from quillmark.llm.rows import occurrences, verse_books
from quillmark.llm.setjoin import similar_links, similar_pairs
from quillmark.sources.tables import table


def _book_roots(spark: SparkSession, d: str) -> DataFrame:
    """(book, root, n): occurrences are counted by verse before the book is joined."""
    by_verse = occurrences(spark, d, "root").where("root is not null").groupBy("verse_id", "root").agg(F.count("*").alias("n"))
    return by_verse.join(verse_books(spark, d), "verse_id").groupBy("book", "root").agg(F.sum("n").alias("n"))


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    out = distinctive_terms(_book_roots(spark, d), "book", "root", min_df=2)
    return out.select("book", "root", (F.round("score", 6) + 0.0).alias("score")).orderBy(F.desc("score"), "book", "root")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The score chooses the candidates, the exact rule is then checked on their counts.

    From n / t >= 8 m / u follows n / t >= (n + m) / (t + u), so that the smoothed probability is no less than the collection's and the
    score is not negative (nought where there is one book). Roots of one book count by the rule, so the cutoff is one record.
    """
    out = distinctive_terms(_book_roots(spark, d), "book", "root", min_df=1).where(F.col("score") >= -1e-12)
    m, u = F.col("term_total") - F.col("n"), F.col("total") - F.col("record_total")
    return out.where((F.col("n") >= 5) & (F.col("n") * u >= 8 * m * F.col("record_total"))).select("book", "root")


def _verse_roots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tokens").select("verse_id", "root")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = co_occurring(_verse_roots(spark, d), "verse_id", "root")
    return out.select(
        F.col("item_a").alias("root_a"), F.col("item_b").alias("root_b"), F.col("together").alias("verses"),
        F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = co_occurring(_verse_roots(spark, d), "verse_id", "root", min_support=5, min_lift=10)
    return out.select(F.col("item_a").alias("root_a"), F.col("item_b").alias("root_b"))


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Each root and lemma with occurrences, verses and the number of verses there are."""
    counts = ngram_counts(occurrences(spark, d, "root", "lemma"), "verse_id", "position", ["root", "lemma"])
    total = table(spark, d, "verses").agg(F.count_distinct("verse_id")).scalar()
    return counts.select(F.col("field").alias("field_name"), F.col("gram")[0].alias("term"), "occurrences", F.col("records").alias("verses")).withColumn("all_verses", total)


def _stated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roots").where("root is not null and weight is not null").select(F.col("root").alias("term"), "weight").distinct()


def _mark() -> Column:
    return F.when(F.col("verses") == 1, "rare").when(F.col("verses") * 10 > F.col("all_verses"), "common").otherwise("useful")


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).select("field_name", "term", "occurrences", "verses", _mark().alias("mark"))


def p6_weights(spark: SparkSession, d: str) -> DataFrame:
    counted = _frequencies(spark, d).where("field_name = 'root'").select("term", "occurrences")
    out = _stated(spark, d).join(counted, "term", "left").select("term", "weight", F.coalesce("occurrences", F.lit(0)).alias("occurrences"))
    return out.withColumn("agrees", F.col("weight") == F.col("occurrences"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    f = _frequencies(spark, d).withColumn("weight", F.lit(None).cast("long"))
    stated = _stated(spark, d).select(F.lit("root").alias("field_name"), "term", F.lit(0).cast("long").alias("occurrences"), F.lit(None).cast("long").alias("verses"), F.lit(None).cast("long").alias("all_verses"), "weight")
    both = f.unionByName(stated).groupBy("field_name", "term").agg(
        F.sum("occurrences").alias("occurrences"), F.max("verses").alias("verses"), F.max("all_verses").alias("all_verses"), F.min("weight").alias("least"), F.max("weight").alias("most")
    )
    marked = F.when(_mark() != "useful", F.col("field_name"))
    wrong = F.when((F.col("least") != F.col("occurrences")) | (F.col("most") != F.col("occurrences")), F.lit("weight"))
    out = both.where("verses is not null or least is not null").select("term", F.explode(F.array_compact(F.array(F.when(F.col("verses").isNotNull(), marked), wrong))).alias("field_name"))
    return out.select("field_name", "term")


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run of up to three roots with its occurrences and verses."""
    out = ngram_counts(occurrences(spark, d, "root"), "verse_id", "position", ["root"], n_max=3)
    return out.select("n", F.array_join("gram", " ").alias("run"), "occurrences", F.col("records").alias("verses"))


def _word_sets(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verses").where("verse_id is not null and word_string is not null")
    return v.select(F.col("verse_id").alias("id"), F.filter(F.split("word_string", " "), lambda x: x != "").alias("items"))


def _root_sets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tokens").where("verse_id is not null and root is not null and not coalesce(is_stop, false)")
    return t.groupBy(F.col("verse_id").alias("id")).agg(F.collect_set("root").alias("items"))


_SETS = {"words": (_word_sets, 10), "roots": (_root_sets, 8)}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [similar_pairs(f(spark, d), least).select(F.lit(k).alias("set_name"), F.col("id_a").alias("verse_a"), F.col("id_b").alias("verse_b")) for k, (f, least) in _SETS.items()]
    return parts[0].unionByName(parts[1])


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    parts = [similar_links(f(spark, d), least).select(F.lit(k).alias("set_name"), F.col("id").alias("verse_id"), "class_id", "copies", "links") for k, (f, least) in _SETS.items()]
    return parts[0].unionByName(parts[1])


_OCC = """
occ AS (SELECT verse_id, position, min(root) AS root, min(lemma) AS lemma FROM tokens WHERE verse_id IS NOT NULL AND position IS NOT NULL GROUP BY 1, 2)
"""
_P1 = f"""WITH {_OCC},
vb AS (SELECT verse_id, min(book) AS book FROM verses WHERE verse_id IS NOT NULL AND book IS NOT NULL GROUP BY 1),
br AS (SELECT book, root, count(*) AS n FROM occ JOIN vb USING (verse_id) WHERE root IS NOT NULL GROUP BY 1, 2),
x AS (SELECT book, root, n, sum(n) OVER (PARTITION BY book) AS t, sum(n) OVER (PARTITION BY root) AS c, sum(n) OVER () AS total, count(*) OVER (PARTITION BY root) AS df FROM br)
"""
_P4 = """WITH r AS (SELECT DISTINCT verse_id, root FROM tokens WHERE root IS NOT NULL AND verse_id IS NOT NULL),
s AS (SELECT root, count(*) AS s FROM r GROUP BY 1), t AS (SELECT count(DISTINCT verse_id) AS n FROM r),
p AS (SELECT a.root AS root_a, b.root AS root_b, count(*) AS k FROM r a JOIN r b ON a.verse_id = b.verse_id AND a.root < b.root GROUP BY 1, 2 HAVING count(*) >= 5),
f AS (SELECT root_a, root_b, k, sa.s AS a, sb.s AS b, n FROM p JOIN s sa ON sa.root = root_a JOIN s sb ON sb.root = root_b CROSS JOIN t WHERE k * n >= 10 * sa.s * sb.s)
"""
_P6 = f"""WITH {_OCC},
l AS (SELECT 'root' AS field_name, root AS term, verse_id FROM occ WHERE root IS NOT NULL UNION ALL SELECT 'lemma', lemma, verse_id FROM occ WHERE lemma IS NOT NULL),
f AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT verse_id) AS verses FROM l GROUP BY 1, 2),
v AS (SELECT count(DISTINCT verse_id) AS n FROM verses),
w AS (SELECT DISTINCT root AS term, weight FROM roots WHERE root IS NOT NULL AND weight IS NOT NULL)
"""
_WORDS = "SELECT DISTINCT verse_id AS id, unnest(string_split(word_string, ' ')) AS t FROM verses WHERE word_string IS NOT NULL AND verse_id IS NOT NULL"
_ROOTS = "SELECT DISTINCT verse_id AS id, root AS t FROM tokens WHERE root IS NOT NULL AND verse_id IS NOT NULL AND is_stop IS NOT TRUE"


def _p7(name: str, rows: str, least: int) -> str:
    return f"""SELECT '{name}' AS set_name, a.id AS verse_a, b.id AS verse_b FROM
    (SELECT r.id, r.t, n FROM ({rows}) r JOIN (SELECT id, count(*) AS n FROM ({rows}) WHERE t <> '' GROUP BY 1 HAVING count(*) >= {least}) USING (id) WHERE t <> '') a
    JOIN (SELECT r.id, r.t, n FROM ({rows}) r JOIN (SELECT id, count(*) AS n FROM ({rows}) WHERE t <> '' GROUP BY 1 HAVING count(*) >= {least}) USING (id) WHERE t <> '') b
    ON a.t = b.t AND a.id < b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))"""


def _p7_links(name: str, rows: str, least: int) -> str:
    return f"""SELECT '{name}' AS set_name, c.id AS verse_id, class_id, copies, coalesce(links, 0) AS links FROM
    (SELECT id, min(id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies FROM (SELECT id, list_sort(list(t)) AS s FROM ({rows}) WHERE t <> '' GROUP BY 1 HAVING count(*) >= {least})) c
    LEFT JOIN (SELECT k, count(DISTINCT o) AS links FROM (SELECT x.class_id AS k, y.class_id AS o FROM
      (SELECT verse_a AS a, verse_b AS b FROM ({_p7(name, rows, least)}) UNION ALL SELECT verse_b, verse_a FROM ({_p7(name, rows, least)})) p
      JOIN (SELECT id, min(id) OVER (PARTITION BY s) AS class_id FROM (SELECT id, list_sort(list(t)) AS s FROM ({rows}) WHERE t <> '' GROUP BY 1)) x ON x.id = p.a
      JOIN (SELECT id, min(id) OVER (PARTITION BY s) AS class_id FROM (SELECT id, list_sort(list(t)) AS s FROM ({rows}) WHERE t <> '' GROUP BY 1)) y ON y.id = p.b) WHERE k <> o GROUP BY 1) l ON l.k = class_id"""


QUERIES = {
    "p1_found": p1_found, "p1_scores": p1_scores, "p4_found": p4_found, "p4_pairs": p4_pairs, "p6_found": p6_found, "p6_terms": p6_terms,
    "p6_weights": p6_weights, "p6_runs": p6_runs, "p7_found": p7_found, "p7_links": p7_links,
}

SQL = {
    "p1_found": f"{_P1} SELECT book, root FROM x WHERE n >= 5 AND n * (total - t) >= 8 * (c - n) * t",
    "p1_scores": f"""{_P1}, y AS (SELECT book, root, (n + 2000.0::DOUBLE * (c::DOUBLE / total::DOUBLE)) / (t + 2000.0::DOUBLE) AS pd, c::DOUBLE / total::DOUBLE AS pc FROM x WHERE df >= 2)
      SELECT book, root, round(pd * ln(pd / pc), 6) + 0.0 AS score FROM y""",
    "p4_found": f"{_P4} SELECT root_a, root_b FROM f",
    "p4_pairs": f"""{_P4} SELECT root_a, root_b, k AS verses, round(k * n / (a * b)::DOUBLE, 6) AS lift,
      CASE WHEN k < a THEN round((1 - b / n::DOUBLE) / (1 - k / a::DOUBLE), 6) END AS conviction FROM f""",
    "p6_found": f"""{_P6} SELECT field_name, term FROM f CROSS JOIN v WHERE verses = 1 OR verses * 10 > n
      UNION SELECT 'weight', w.term FROM w LEFT JOIN f ON f.field_name = 'root' AND f.term = w.term WHERE weight <> coalesce(occurrences, 0)""",
    "p6_terms": f"{_P6} SELECT field_name, term, occurrences, verses, CASE WHEN verses = 1 THEN 'rare' WHEN verses * 10 > n THEN 'common' ELSE 'useful' END AS mark FROM f CROSS JOIN v",
    "p6_weights": f"{_P6} SELECT w.term, weight, coalesce(occurrences, 0) AS occurrences, weight = coalesce(occurrences, 0) AS agrees FROM w LEFT JOIN f ON f.field_name = 'root' AND f.term = w.term",
    "p6_runs": f"""WITH {_OCC}, g AS (SELECT 1 AS n, root AS run, verse_id FROM occ WHERE root IS NOT NULL
      UNION ALL SELECT 2, a.root || ' ' || b.root, a.verse_id FROM occ a JOIN occ b ON a.verse_id = b.verse_id AND b.position = a.position + 1 WHERE a.root IS NOT NULL AND b.root IS NOT NULL
      UNION ALL SELECT 3, a.root || ' ' || b.root || ' ' || c.root, a.verse_id FROM occ a JOIN occ b ON a.verse_id = b.verse_id AND b.position = a.position + 1
        JOIN occ c ON a.verse_id = c.verse_id AND c.position = a.position + 2 WHERE a.root IS NOT NULL AND b.root IS NOT NULL AND c.root IS NOT NULL)
      SELECT n, run, count(*) AS occurrences, count(DISTINCT verse_id) AS verses FROM g GROUP BY 1, 2""",
    "p7_links": f"{_p7_links('words', _WORDS, 10)} UNION ALL {_p7_links('roots', _ROOTS, 8)}",
    "p7_found": f"{_p7('words', _WORDS, 10)} UNION ALL {_p7('roots', _ROOTS, 8)}",
}
