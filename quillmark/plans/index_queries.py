"""Indexes by window, version and scope, and controls: what a strip's windows hold, which verses a kept map pairs, how chance pairs score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillmark.functions import measures as M
from quillmark.operators import align as A, corpus as C, facts as X, strips as H
from quillmark.plans import link_queries as K, mining_queries as W, style_queries as Y
from quillmark.plans.fact_queries import _T
from quillmark.plans.mining_queries import SQL as MINING_SQL, _TR
from quillmark.plans.style_queries import _ST
from quillmark.sources.tables import table

R = M.rounded

# Glosses of place and position, repeated as connection, not for weight.
PLACES = ("before", "after", "among", "midst", "against", "upon", "under", "beside", "about", "round", "behind", "above", "without", "within", "toward", "through", "between", "beneath")
#: Most used roots of each language that count as too common to hammer.
COMMONEST = 100


def hammer_skips(spark: SparkSession, d: str) -> DataFrame:
    """Roots that a window may repeat without weight: the most used of each language, those mostly said with function words, words of place."""
    t = C.tokens(spark, d).where(F.col("root").rlike(C.ROOT))
    n = t.groupBy("root").agg(F.count("*").alias("uses"), F.count_if("is_stop").alias("stops"))
    form = X.commonest(t.where("surface is not null"), ["root"], "surface").select("root", F.lower("surface").alias("form"))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("uses"), "root"))
    n = n.withColumn("language", F.substring("root", 1, 1))
    top = n.withColumn("rank", rank).where(F.col("rank") <= COMMONEST).select("root", F.lit(True).alias("common"))
    x = n.join(top, "root", "left").join(form, "root", "left")
    why = F.when(F.col("common"), "common").when(F.col("stops") * 2 >= F.col("uses"), "function").when(F.col("form").isin(*PLACES), "place")
    return x.select("root", why.alias("reason")).where("reason is not null")


def strip_hammer_heavy(spark: SparkSession, d: str) -> DataFrame:
    """The root each window repeats most, of those that aren't skipped."""
    skips = hammer_skips(spark, d).select("root", F.lit(True).alias("skip"))
    n = Y._windows(spark, d).select("book", "start", F.explode("roots").alias("root")).groupBy("book", "start", "root").agg(F.count("*").alias("n"))
    n = n.join(skips, "root", "left").where("skip is null")
    out = n.groupBy("book", "start").agg(F.min(F.struct((-F.col("n")).alias("n"), "root")).alias("b"))
    return out.select("book", "start", F.col("b.root").alias("hammer_root"), (-F.col("b.n")).alias("top"))


def window_roots(spark: SparkSession, d: str) -> DataFrame:
    """Every window of a strip with its roots and their uses: the matrix that evaluations start from."""
    return Y._windows(spark, d).select("book", "start", F.explode("roots").alias("root")).groupBy("book", "start", "root").agg(F.count("*").alias("uses"))


def strip_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """How unlike the renderings of a window's roots are on average, of roots that two witnesses have."""
    r = W.disagreement(spark, d).where("disagreement is not null").select("root", "disagreement")
    return window_roots(spark, d).join(r, "root").groupBy("book", "start").agg(R(F.sum(F.col("uses") * F.col("disagreement")) / F.sum("uses"), 4).alias("disagreement"), F.sum("uses").alias("words"))


def theme_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The references of each theme's scope: verses of a chapter that follow each other as one range."""
    v = C.verses(spark, d).where("book is not null and verse is not null").select("verse_id", "book", "chapter", "verse")
    t = table(spark, d, "theme_verse").where("theme_id is not null and coalesce(role, '') <> 'excluded'").select("theme_id", "verse_id").distinct().join(v, "verse_id").select("theme_id", "book", "chapter", "verse").distinct()
    w = Window.partitionBy("theme_id", "book", "chapter").orderBy("verse")
    return t.withColumn("island", F.col("verse") - F.row_number().over(w)).groupBy("theme_id", "book", "chapter", "island").agg(F.min("verse").alias("first"), F.max("verse").alias("last")).drop("island")


def sense_map(spark: SparkSession, d: str) -> DataFrame:
    """For each root its trusted renderings in one row, the likeliest first."""
    t = W._trusted(spark, d).select("s", "t", R(F.col("p"), 4).alias("p"))
    return t.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("k"), "t"))), lambda x: x["t"]), " ").alias("senses"), F.count("*").alias("n"))


def verse_pairings(spark: SparkSession, d: str) -> DataFrame:
    """In each verse the rendering that the kept map pairs best with each root there."""
    kept = W._trusted(spark, d).select("s", "t", R(F.col("p") * F.col("back"), 6).alias("k"))
    pairs = W._alignment(spark, d).where(F.col("s") != A.NULL).join(kept, ["s", "t"])
    return pairs.groupBy("verse_id", "s").agg(F.min(F.struct((-F.col("k")).alias("k"), "t")).alias("b")).select("verse_id", "s", F.col("b.t").alias("t"))


def version_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of three in the units and in the words of the verses that two to six verses hold: an index of echoes by version."""
    u = C.units(spark, d)

    def threes(c: str) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), lambda i: i <= F.size(c) - 2)
        return F.transform(starts, lambda i: F.array_join(F.slice(c, i, 3), " "))

    each = F.array(*(F.struct(F.lit(n).alias("version"), threes(n).alias("runs")) for n in ("units", "words")))
    r = u.select("verse_id", "book", F.explode(each).alias("x")).select("verse_id", "book", "x.version", F.explode("x.runs").alias("run")).distinct()
    return r.groupBy("version", "run").agg(F.count("*").alias("verses"), F.count_distinct("book").alias("books")).where("verses between 2 and 6")


def control_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Kin pairs against controls, each with the verse after its partner instead: pairs and content roots shared on average."""
    v = H.numbered(C.verses(spark, d).where("book is not null")).select("verse_id", "book", "i")
    after = v.join(v.select("book", (F.col("i") - 1).alias("i"), F.col("verse_id").alias("next")), ["book", "i"]).select(F.col("verse_id").alias("verse_b"), "next")
    k = K.kin(spark, d).select("verse_a", "verse_b")
    both = k.withColumn("kind", F.lit("kin")).unionByName(k.join(after, "verse_b").where("next <> verse_a").select("verse_a", F.col("next").alias("verse_b"), F.lit("control").alias("kind")))
    roots = C.content(spark, d).groupBy("verse_id").agg(F.collect_set("root").alias("r"))
    x = both.join(roots.toDF("verse_a", "ra"), "verse_a", "left").join(roots.toDF("verse_b", "rb"), "verse_b", "left")
    shared = F.coalesce(F.size(F.array_intersect("ra", "rb")), F.lit(0))
    shared = F.when(F.col("ra").isNull() | F.col("rb").isNull(), 0).otherwise(shared)
    return x.groupBy("kind").agg(F.count("*").alias("pairs"), R(F.avg(shared)).alias("shared"))


QUERIES = {f.__name__: f for f in (hammer_skips, strip_hammer_heavy, window_roots, strip_disagreement, theme_ranges, sense_map, verse_pairings, version_runs, control_pairs)}

_HK = f"""hu AS (SELECT root, count(*) AS uses, count(*) FILTER (is_stop) AS stops FROM tk WHERE regexp_matches(root, '^[HG]\\d+$') GROUP BY 1), hf AS (SELECT root, lower(surface) AS form FROM (SELECT root, surface, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, surface) AS k FROM tk WHERE surface IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
hk AS (SELECT root, CASE WHEN k <= {COMMONEST} THEN 'common' WHEN stops * 2 >= uses THEN 'function' WHEN form IN {PLACES} THEN 'place' END AS reason FROM (SELECT hu.*, form, row_number() OVER (PARTITION BY left(hu.root, 1) ORDER BY uses DESC, hu.root) AS k FROM hu LEFT JOIN hf ON hf.root = hu.root))
"""
_WR = f"""{_ST}, vr AS (SELECT v.book, v.i, root, count(*) AS n FROM v JOIN ct USING (verse_id) GROUP BY 1, 2, 3), wr0 AS (SELECT wk0.book, start, root, sum(n)::BIGINT AS uses FROM wk0 JOIN vr ON vr.book = wk0.book AND i BETWEEN start AND start + 9 GROUP BY 1, 2, 3)
"""

SQL = {
    "hammer_skips": f"{_T}, {_HK} SELECT root, reason FROM hk WHERE reason IS NOT NULL",
    "strip_hammer_heavy": f"{_WR}, {_HK} SELECT book, start, root AS hammer_root, uses AS top FROM (SELECT *, row_number() OVER (PARTITION BY book, start ORDER BY uses DESC, root) AS k FROM wr0 WHERE root NOT IN (SELECT root FROM hk WHERE reason IS NOT NULL)) WHERE k = 1",
    "window_roots": f"{_WR} SELECT book, start, root, uses FROM wr0",
    "strip_disagreement": f"{_WR}, dg AS ({MINING_SQL['disagreement']}) SELECT book, start, round(sum(uses * disagreement) / sum(uses), 4) + 0.0 AS disagreement, sum(uses)::BIGINT AS words FROM wr0 JOIN dg USING (root) WHERE disagreement IS NOT NULL GROUP BY 1, 2",
    "theme_ranges": f"""{_T}, t AS (SELECT DISTINCT theme_id, vb.book, vb.chapter, vb.verse FROM theme_verse tv JOIN vb ON vb.verse_id = tv.verse_id WHERE theme_id IS NOT NULL AND coalesce(role, '') <> 'excluded' AND vb.book IS NOT NULL AND vb.verse IS NOT NULL)
      SELECT theme_id, book, chapter, min(verse) AS first, max(verse) AS last FROM (SELECT *, verse - row_number() OVER (PARTITION BY theme_id, book, chapter ORDER BY verse) AS isl FROM t) GROUP BY theme_id, book, chapter, isl""",
    "sense_map": f"{_TR} SELECT s, string_agg(t, ' ' ORDER BY round(p, 4) DESC, t) AS senses, count(*) AS n FROM tr GROUP BY 1",
    "verse_pairings": f"{_TR} SELECT verse_id, s, t FROM (SELECT verse_id, pr.s, pr.t, row_number() OVER (PARTITION BY verse_id, pr.s ORDER BY round(tr.p * tr.back, 6) DESC, pr.t) AS k FROM pr JOIN tr ON tr.s = pr.s AND tr.t = pr.t) WHERE k = 1",
    "version_runs": f"""{_T}, r AS (SELECT DISTINCT 'units' AS version, verse_id, book, array_to_string(units[i : i + 2], ' ') AS run FROM (SELECT *, unnest(range(1, len(units) - 1)) AS i FROM un) UNION ALL SELECT DISTINCT 'words', verse_id, book, array_to_string(words[i : i + 2], ' ') FROM (SELECT *, unnest(range(1, len(words) - 1)) AS i FROM un))
      SELECT version, run, count(*) AS verses, count(DISTINCT book) AS books FROM r GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 6""",
    "control_pairs": f"""WITH k AS ({K.SQL['kin']}), b2 AS (SELECT verse_id, min(book) AS book, min(chapter) AS chapter, min(verse) AS verse FROM verses WHERE verse_id IS NOT NULL GROUP BY 1), nx AS (SELECT verse_id, lead(verse_id) OVER (PARTITION BY book ORDER BY chapter, verse, verse_id) AS nxt FROM b2 WHERE book IS NOT NULL),
      p AS (SELECT 'kin' AS kind, verse_a, verse_b FROM k UNION ALL SELECT 'control', verse_a, nxt FROM k JOIN nx ON nx.verse_id = verse_b WHERE nxt IS NOT NULL AND nxt <> verse_a), c AS (SELECT DISTINCT verse_id, root FROM (SELECT verse_id, position, min(root) AS root, coalesce(bool_or(is_stop), false) AS stop FROM tokens WHERE verse_id IS NOT NULL AND position IS NOT NULL GROUP BY 1, 2) WHERE root IS NOT NULL AND NOT stop)
      SELECT kind, count(*) AS pairs, round(avg((SELECT count(*) FROM c x JOIN c y ON x.root = y.root WHERE x.verse_id = verse_a AND y.verse_id = verse_b)), 6) + 0.0 AS shared FROM p GROUP BY 1""",
}
