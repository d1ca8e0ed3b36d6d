"""Words without a number beside words with one: by gloss, by company, by the root's uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillmark.functions import measures as M
from quillmark.operators import corpus as C
from quillmark.plans.fact_queries import _T
from quillmark.sources.tables import table

R = M.rounded


def _beside(spark: SparkSession, d: str, over: int) -> DataFrame:
    """Words in lower case with their number, and the numbered words before and after across at most ``over`` function words."""
    t = C.tokens(spark, d).where("surface is not null").withColumn("tag", F.when(F.col("root").rlike(C.ROOT) & ~F.col("is_stop"), F.col("root")))
    w = Window.partitionBy("verse_id").orderBy("position")
    here = F.struct("tag", "is_stop")

    def near(step) -> Column:
        seen = [step(here, k).over(w) for k in range(1, over + 2)]
        out = F.lit(None).cast("string")
        for s in reversed(seen):  # the nearest one decides: numbered, a function word to look past, or an end
            out = F.when(s["tag"].isNotNull(), s["tag"]).when(s["is_stop"], out)
        return out

    return t.select("verse_id", F.lower("surface").alias("word"), "tag", "is_stop", near(F.lag).alias("before"), near(F.lead).alias("after"))


def gloss_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Untagged words with a tagged word before or after, across two function words at most, whose gloss names them."""
    g = table(spark, d, "lexicon_forms").where("strongs is not null and translit is not null").select(F.col("strongs").alias("mate"), F.lower("translit").alias("word")).distinct()
    x = _beside(spark, d, 2).where("tag is null and not is_stop").select("word", F.explode(F.array_distinct(F.array_compact(F.array("before", "after")))).alias("mate"))
    return x.join(g, ["word", "mate"]).groupBy("word", "mate").agg(F.count("*").alias("uses"))


def company_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The tagged word that an untagged one stands beside, one function word between them at most, in three fifths of its uses, of five or more."""
    x = _beside(spark, d, 1).where("tag is null and not is_stop")
    total = x.groupBy("word").agg(F.count("*").alias("total")).where("total >= 5")
    n = x.select("word", F.explode(F.array_distinct(F.array_compact(F.array("before", "after")))).alias("mate")).groupBy("word", "mate").agg(F.count("*").alias("n"))
    best = n.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("n"), "mate")).alias("b")).join(total, "word")
    return best.select("word", F.col("b.mate").alias("mate"), (-F.col("b.n")).alias("uses"), "total").where("uses * 5 >= total * 3")


def root_companions(spark: SparkSession, d: str) -> DataFrame:
    """Untagged words that stand directly beside a root in three tenths of its uses or more: words that belong to it. Roots of five uses or more."""
    w = Window.partitionBy("verse_id").orderBy("position")
    t = C.tokens(spark, d).where("surface is not null").withColumn("tag", F.when(F.col("root").rlike(C.ROOT) & ~F.col("is_stop"), F.col("root")))
    bare = F.when(F.col("tag").isNull() & ~F.col("is_stop"), F.lower("surface"))
    x = t.select("tag", F.lag(bare).over(w).alias("before"), F.lead(bare).over(w).alias("after")).where("tag is not null")
    total = x.groupBy("tag").agg(F.count("*").alias("total")).where("total >= 5")
    n = x.select("tag", F.explode(F.array_distinct(F.array_compact(F.array("before", "after")))).alias("word")).groupBy("tag", "word").agg(F.count("*").alias("uses"))
    return n.join(total, "tag").where("uses * 10 >= total * 3").select(F.col("tag").alias("root"), "word", "uses", "total")


QUERIES = {f.__name__: f for f in (gloss_neighbours, company_neighbours, root_companions)}


def _near(step: str, over: int) -> str:
    out = "NULL"
    for k in range(over + 1, 0, -1):
        out = f"CASE WHEN {step}(tag, {k}) OVER w IS NOT NULL THEN {step}(tag, {k}) OVER w WHEN {step}(is_stop, {k}) OVER w THEN {out} END"
    return out


def _words(over: int) -> str:
    return f"""{_T}, t AS (SELECT verse_id, position, lower(surface) AS word, is_stop, CASE WHEN regexp_matches(root, '^[HG]\\d+$') AND NOT is_stop THEN root END AS tag FROM tk WHERE surface IS NOT NULL),
x AS (SELECT *, {_near('lag', over)} AS a, {_near('lead', over)} AS b FROM t WINDOW w AS (PARTITION BY verse_id ORDER BY position)),
m AS (SELECT word, a AS mate FROM x WHERE tag IS NULL AND NOT is_stop AND a IS NOT NULL UNION ALL SELECT word, b FROM x WHERE tag IS NULL AND NOT is_stop AND b IS NOT NULL AND b IS DISTINCT FROM a)
"""


SQL = {
    "gloss_neighbours": f"{_words(2)}, g AS (SELECT DISTINCT strongs AS mate, lower(translit) AS word FROM lexicon_forms WHERE strongs IS NOT NULL AND translit IS NOT NULL) SELECT word, mate, count(*) AS uses FROM m JOIN g USING (word, mate) GROUP BY 1, 2",
    "company_neighbours": f"""{_words(1)}, z AS (SELECT word, count(*) AS total FROM x WHERE tag IS NULL AND NOT is_stop GROUP BY 1 HAVING count(*) >= 5), n AS (SELECT word, mate, count(*) AS uses, row_number() OVER (PARTITION BY word ORDER BY count(*) DESC, mate) AS k FROM m GROUP BY 1, 2)
      SELECT word, mate, uses, total FROM n JOIN z USING (word) WHERE k = 1 AND uses * 5 >= total * 3""",
    "root_companions": f"""{_words(0)}, y AS (SELECT tag, CASE WHEN lag(tag) OVER w IS NULL AND NOT lag(is_stop) OVER w THEN lag(word) OVER w END AS p, CASE WHEN lead(tag) OVER w IS NULL AND NOT lead(is_stop) OVER w THEN lead(word) OVER w END AS q FROM t WINDOW w AS (PARTITION BY verse_id ORDER BY position)),
      z AS (SELECT tag, count(*) AS total FROM y WHERE tag IS NOT NULL GROUP BY 1 HAVING count(*) >= 5), n AS (SELECT tag, word, count(*) AS uses FROM (SELECT tag, p AS word FROM y WHERE p IS NOT NULL UNION ALL SELECT tag, q FROM y WHERE q IS NOT NULL AND q IS DISTINCT FROM p) WHERE tag IS NOT NULL GROUP BY 1, 2)
      SELECT tag AS root, word, uses, total FROM n JOIN z USING (tag) WHERE uses * 10 >= total * 3""",
}
