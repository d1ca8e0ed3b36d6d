"""Details behind the reports: parsings, frames, pairs in detail, places of words, rates of linked pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillmark.functions import measures as M, text as T
from quillmark.operators import corpus as C, facts as X, strips as H
from quillmark.plans import link_queries as K, style_queries as Y
from quillmark.plans.fact_queries import _T
from quillmark.plans.link_queries import _PV
from quillmark.plans.style_queries import _DL
from quillmark.sources.tables import table

R = M.rounded
#: Verses in a frame.
FRAME = 10


def parsings(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences by all fields of their parsing code: kind of word, stem or tense, form or mood, voice, person, gender, number, state or case, kind of name."""
    m = F.coalesce("morph", F.lit(""))
    h = F.regexp_replace(m, "^H(?=[A-Z])", "")
    hebrew = m.rlike("^H[A-Z]")
    at = lambda p, i, c=h: F.regexp_extract(c, p, i)
    verb, noun = r"^V([a-zA-Z])([a-z])([123]?)([mfbc]?)([spd]?)([acd]?)$", r"^[NA]([a-z])([mfbc]?)([spd]?)([acd]?)$"
    gverb, tail = r"^V-2?([A-Z])([A-Z])([A-Z])", r"-([NGDAV])([SP])([MFN]?)$"
    person = at(r"-([123])([SP])$", 1, m)
    fields = {
        "part": F.coalesce(T.part_of_speech(F.nullif(m, F.lit(""))), F.lit("none")),
        "stem": F.when(hebrew, at(verb, 1)).otherwise(at(gverb, 1, m)), "form": F.when(hebrew, at(verb, 2)).otherwise(at(gverb, 3, m)), "voice": F.when(hebrew, "").otherwise(at(gverb, 2, m)),
        "person": F.when(hebrew, at(verb, 3)).otherwise(person),
        "gender": F.when(hebrew, F.concat(at(verb, 4), at(noun, 2))).otherwise(at(tail, 3, m)),
        "number": F.when(hebrew, F.concat(at(verb, 5), at(noun, 3))).otherwise(F.concat(at(r"-([123])([SP])$", 2, m), at(tail, 2, m))),
        "state": F.when(hebrew, F.concat(at(verb, 6), at(noun, 4))).otherwise(at(tail, 1, m)),
        "name": F.when(hebrew & h.rlike("^Np"), F.when(h.rlike("^Npl"), "place").when(h.rlike("^Np[mf]"), "person").otherwise("name")).when(hebrew & h.rlike("^Ng"), "people").otherwise(""),
    }
    return C.tokens(spark, d).select(*(c.alias(k) for k, c in fields.items())).groupBy(*fields).agg(F.count("*").alias("uses"))


def verb_persons(spark: SparkSession, d: str) -> DataFrame:
    """Verbs of each chapter by person and number."""
    m = F.col("morph")
    person = F.coalesce(F.nullif(F.regexp_extract(m, r"^H?V[a-zA-Z][a-z]([123])[mfbc]?[spd]?", 1), F.lit("")), F.nullif(F.regexp_extract(m, r"^V-.*-([123])[SP]$", 1), F.lit("")))
    number = F.coalesce(F.nullif(F.regexp_extract(m, r"^H?V[a-zA-Z][a-z][123][mfbc]?([spd])", 1), F.lit("")), F.nullif(F.lower(F.regexp_extract(m, r"^V-.*-[123]([SP])$", 1)), F.lit("")))
    t = C.tokens(spark, d).where(m.rlike("^H?V")).select("book", "chapter", person.alias("person"), number.alias("number")).where("person is not null")
    return t.groupBy("book", "chapter", "person", "number").agg(F.count("*").alias("uses"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    v = H.numbered(C.verses(spark, d).where("book is not null")).select("verse_id", F.floor(F.col("i") / FRAME).alias("frame"))
    return C.content(spark, d).select("verse_id", "book", "root").join(v, "verse_id").groupBy("book", "frame", "root").agg(F.count("*").alias("n"))


def frame_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Distance of the word mix of each ten verses from that of the ten before: Hellinger's, and one less the cosine."""
    f = _frames(spark, d)
    size = f.groupBy("book", "frame").agg(F.sum("n").alias("size"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    p = f.join(size, ["book", "frame"])
    q = p.select("book", (F.col("frame") + 1).alias("frame"), "root", F.col("n").alias("n2"), F.col("size").alias("size2"), F.col("length").alias("length2"))
    both = p.join(q, ["book", "frame", "root"]).groupBy("book", "frame").agg(F.sum(F.sqrt(F.col("n") / F.col("size") * F.col("n2") / F.col("size2"))).alias("h"), F.sum(F.col("n") * F.col("n2") / (F.col("length") * F.col("length2"))).alias("c"))
    pairs = size.select("book", "frame").join(size.select("book", (F.col("frame") + 1).alias("frame")), ["book", "frame"]).join(both, ["book", "frame"], "left")
    zero = F.lit(0.0)
    return pairs.select("book", "frame", R(F.sqrt(F.greatest(zero, 1 - F.coalesce("h", zero)))).alias("hellinger"), R(1 - F.coalesce("c", zero)).alias("cosine"))


def shift_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Frames that shift more than the two before and the two after them: where a book changes."""
    w = Window.partitionBy("book").orderBy("frame").rangeBetween(-2, 2)
    s = frame_shifts(spark, d).withColumn("top", F.max("hellinger").over(w)).withColumn("held", F.count("*").over(w)).withColumn("first", F.min(F.struct((-F.col("hellinger")).alias("h"), "frame")).over(w))
    return s.where((F.col("held") >= 3) & (F.col("first.frame") == F.col("frame"))).select("book", "frame", "hellinger")


def passage_places(spark: SparkSession, d: str) -> DataFrame:
    """The verses behind each content word of a passage."""
    return K.passage_verses(spark, d).join(C.content(spark, d).select("verse_id", "root"), "verse_id").groupBy("passage_id", "root", "verse_id").agg(F.count("*").alias("uses"))


def second_language(spark: SparkSession, d: str) -> DataFrame:
    """Verses in another language than most of their book, with their content words and those that the book has nowhere else."""
    v = C.verses(spark, d).where("book is not null and language is not null").select("verse_id", "book", "language")
    main = X.commonest(v, ["book"], "language").select("book", F.col("language").alias("main"))
    odd = v.join(main, "book").where("language <> main")
    c = C.content(spark, d).select("verse_id", "book", "root").join(odd.select("verse_id", F.lit(True).alias("odd")), "verse_id", "left")
    own = c.groupBy("book", "root").agg(F.bool_and(F.coalesce("odd", F.lit(False))).alias("only"))
    n = c.where("odd").join(own, ["book", "root"]).groupBy("verse_id").agg(F.count("*").alias("words"), F.count_if("only").alias("only_here"))
    return odd.join(n, "verse_id", "left").select("book", "verse_id", "language", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("only_here", F.lit(0)).alias("only_here"))


def delta_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The five words that set two books furthest apart, for each pair."""
    z = Y._z(spark, d).select("book", "feature", "z")
    a, b = (z.select("feature", F.col("book").alias(f"book_{x}"), F.col("z").alias(f"z_{x}")) for x in "ab")
    pairs = a.join(b, "feature").where("book_a < book_b").withColumn("apart", R(F.abs(F.col("z_a") - F.col("z_b"))))
    return X.top_k(pairs, ["book_a", "book_b"], [F.desc("apart"), F.col("feature")], 5).select("book_a", "book_b", "rank", "feature", "apart")


def theme_homes(spark: SparkSession, d: str) -> DataFrame:
    """The book that holds most of a theme, with the chapters it is at home in: the span of those where it is over its lift of one."""
    s = K.theme_strip(spark, d)
    n = s.groupBy("theme_id", "book").agg(F.sum("observed").alias("verses"))
    home = X.top_k(n, ["theme_id"], [F.desc("verses"), F.col("book")], 1).select("theme_id", "book", "verses")
    span = s.where("lift > 1").groupBy("theme_id", "book").agg(F.min("chapter").alias("first"), F.max("chapter").alias("last"))
    return home.join(span, ["theme_id", "book"], "left").select("theme_id", F.col("book").alias("home"), "verses", "first", "last")


def linked_rates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of verses by how they were found, the share that a cross reference lists, and the share of any two verses that one lists."""
    votes = K.link_votes(spark, d).where("from_verse <> to_verse").select(F.least("from_verse", "to_verse").alias("verse_a"), F.greatest("from_verse", "to_verse").alias("verse_b")).distinct()
    every = C.verses(spark, d).agg((F.count("*") * (F.count("*") - 1) / 2).alias("n")).scalar()
    found = K.kin(spark, d).select(F.lit("kin").alias("by"), "verse_a", "verse_b").unionByName(K.parallel_runs(spark, d).select(F.lit("runs").alias("by"), "verse_a", "verse_b"))
    x = found.join(votes.withColumn("listed", F.lit(True)), ["verse_a", "verse_b"], "left").groupBy("by").agg(F.count("*").alias("pairs"), F.count("listed").alias("linked"))
    return x.withColumn("listed", votes.agg(F.count("*")).scalar()).withColumn("every", every).select("by", "pairs", "linked", R(F.col("linked") / F.col("pairs")).alias("rate"), R(F.col("listed") / F.col("every"), 9).alias("any_two"))


def parsed_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Written references of the cross references, read with an end in a later chapter too."""
    r = table(spark, d, "cross_references").select(F.explode(F.array("from_reference", "to_reference")).alias("reference")).where("reference is not null").distinct()
    return r.select("reference", T.reference_range("reference").alias("r")).where("r is not null").select("reference", "r.*")


QUERIES = {f.__name__: f for f in (parsings, verb_persons, frame_shifts, shift_peaks, passage_places, second_language, delta_pairs, theme_homes, linked_rates, parsed_ranges)}

_V1 = "'^V([a-zA-Z])([a-z])([123]?)([mfbc]?)([spd]?)([acd]?)$'"
_N1 = "'^[NA]([a-z])([mfbc]?)([spd]?)([acd]?)$'"
_FS = f"""{_T}, v AS (SELECT verse_id, (row_number() OVER (PARTITION BY book ORDER BY chapter, verse, verse_id) - 1) // 10 AS frame FROM vb WHERE book IS NOT NULL), f AS (SELECT book, frame, root, count(*) AS n FROM ct JOIN v USING (verse_id) GROUP BY 1, 2, 3),
z AS (SELECT book, frame, sum(n) AS s, sqrt(sum(n * n)) AS l FROM f GROUP BY 1, 2), b AS (SELECT y.book, y.frame, sum(sqrt(x.n / zx.s::DOUBLE * y.n / zy.s::DOUBLE)) AS h, sum(x.n * y.n / (zx.l * zy.l)) AS c FROM f x JOIN f y ON x.book = y.book AND x.frame + 1 = y.frame AND x.root = y.root
  JOIN z zx ON zx.book = x.book AND zx.frame = x.frame JOIN z zy ON zy.book = y.book AND zy.frame = y.frame GROUP BY 1, 2),
fs AS (SELECT z.book, z.frame, round(sqrt(greatest(0.0, 1 - coalesce(h, 0))), 6) + 0.0 AS hellinger, round(1 - coalesce(c, 0), 6) + 0.0 AS cosine FROM z JOIN z p ON p.book = z.book AND p.frame + 1 = z.frame LEFT JOIN b ON b.book = z.book AND b.frame = z.frame)
"""
_RR = r"'^\s*([1-3]?\s?[^\d]+?)\.?\s+(\d+)\s*[:.]\s*(\d+)(?:\s*[-–]\s*(?:(\d+)\s*[:.]\s*)?(\d+))?\s*$'"

SQL = {
    "parsings": f"""{_T}, m AS (SELECT coalesce(morph, '') AS m, regexp_replace(coalesce(morph, ''), '^H([A-Z])', '\\1') AS h, regexp_matches(coalesce(morph, ''), '^H[A-Z]') AS heb FROM tk),
      f AS (SELECT CASE WHEN m = '' THEN 'none' WHEN m = 'PREP' THEN 'preposition' WHEN m = 'CONJ' THEN 'conjunction' ELSE coalesce(CASE left(CASE WHEN heb THEN h ELSE m END, 1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.PARTS.items())} END, 'none') END AS part,
        CASE WHEN heb THEN regexp_extract(h, {_V1}, 1) ELSE regexp_extract(m, '^V-2?([A-Z])([A-Z])([A-Z])', 1) END AS stem, CASE WHEN heb THEN regexp_extract(h, {_V1}, 2) ELSE regexp_extract(m, '^V-2?([A-Z])([A-Z])([A-Z])', 3) END AS form,
        CASE WHEN heb THEN '' ELSE regexp_extract(m, '^V-2?([A-Z])([A-Z])([A-Z])', 2) END AS voice, CASE WHEN heb THEN regexp_extract(h, {_V1}, 3) ELSE regexp_extract(m, '-([123])[SP]$', 1) END AS person,
        CASE WHEN heb THEN regexp_extract(h, {_V1}, 4) || regexp_extract(h, {_N1}, 2) ELSE regexp_extract(m, '-[NGDAV][SP]([MFN]?)$', 1) END AS gender,
        CASE WHEN heb THEN regexp_extract(h, {_V1}, 5) || regexp_extract(h, {_N1}, 3) ELSE regexp_extract(m, '-[123]([SP])$', 1) || regexp_extract(m, '-[NGDAV]([SP])[MFN]?$', 1) END AS number,
        CASE WHEN heb THEN regexp_extract(h, {_V1}, 6) || regexp_extract(h, {_N1}, 4) ELSE regexp_extract(m, '-([NGDAV])[SP][MFN]?$', 1) END AS state,
        CASE WHEN heb AND starts_with(h, 'Npl') THEN 'place' WHEN heb AND regexp_matches(h, '^Np[mf]') THEN 'person' WHEN heb AND starts_with(h, 'Np') THEN 'name' WHEN heb AND starts_with(h, 'Ng') THEN 'people' ELSE '' END AS name FROM m)
      SELECT part, stem, form, voice, person, gender, number, state, name, count(*) AS uses FROM f GROUP BY ALL""",
    "verb_persons": f"""{_T}, p AS (SELECT book, chapter, coalesce(nullif(regexp_extract(morph, '^H?V[a-zA-Z][a-z]([123])', 1), ''), nullif(regexp_extract(morph, '^V-.*-([123])[SP]$', 1), '')) AS person,
      coalesce(nullif(regexp_extract(morph, '^H?V[a-zA-Z][a-z][123][mfbc]?([spd])', 1), ''), nullif(lower(regexp_extract(morph, '^V-.*-[123]([SP])$', 1)), '')) AS number FROM tk WHERE regexp_matches(morph, '^H?V')) SELECT *, count(*) AS uses FROM p WHERE person IS NOT NULL GROUP BY ALL""",
    "frame_shifts": f"{_FS} SELECT * FROM fs",
    "shift_peaks": f"""{_FS} SELECT x.book, x.frame, x.hellinger FROM fs x WHERE (SELECT count(*) FROM fs y WHERE y.book = x.book AND abs(y.frame - x.frame) <= 2) >= 3
      AND NOT EXISTS (SELECT 1 FROM fs y WHERE y.book = x.book AND abs(y.frame - x.frame) <= 2 AND (y.hellinger > x.hellinger OR (y.hellinger = x.hellinger AND y.frame < x.frame)))""",
    "passage_places": f"{_PV} SELECT passage_id, root, verse_id, count(*) AS uses FROM pv JOIN ct USING (verse_id) GROUP BY 1, 2, 3",
    "second_language": f"""{_T}, v AS (SELECT verse_id, book, language FROM vb WHERE book IS NOT NULL AND language IS NOT NULL), m AS (SELECT book, language AS main FROM (SELECT book, language, row_number() OVER (PARTITION BY book ORDER BY count(*) DESC, language) AS k FROM v GROUP BY 1, 2) WHERE k = 1),
      o AS (SELECT v.* FROM v JOIN m USING (book) WHERE language <> main), c AS (SELECT ct.verse_id, ct.book, root, o.verse_id IS NOT NULL AS odd FROM ct LEFT JOIN o ON o.verse_id = ct.verse_id), w AS (SELECT book, root, bool_and(odd) AS own FROM c GROUP BY 1, 2),
      n AS (SELECT verse_id, count(*) AS words, count(*) FILTER (own) AS own FROM c JOIN w USING (book, root) WHERE odd GROUP BY 1) SELECT book, o.verse_id, language, coalesce(words, 0) AS words, coalesce(own, 0) AS only_here FROM o LEFT JOIN n USING (verse_id)""",
    "delta_pairs": f"""{_DL}, pr2 AS (SELECT a.book AS book_a, b.book AS book_b, a.feature, round(abs(a.z - b.z), 6) + 0.0 AS apart FROM zs a JOIN zs b ON a.feature = b.feature AND a.book < b.book)
      SELECT book_a, book_b, rank::INT AS rank, feature, apart FROM (SELECT *, row_number() OVER (PARTITION BY book_a, book_b ORDER BY apart DESC, feature) AS rank FROM pr2) WHERE rank <= 5""",
    "theme_homes": f"""WITH s AS ({K.SQL['theme_strip']}), n AS (SELECT theme_id, book, sum(observed)::BIGINT AS verses, row_number() OVER (PARTITION BY theme_id ORDER BY sum(observed) DESC, book) AS k FROM s GROUP BY 1, 2)
      SELECT n.theme_id, n.book AS home, verses, (SELECT min(chapter) FROM s WHERE s.theme_id = n.theme_id AND s.book = n.book AND lift > 1) AS first, (SELECT max(chapter) FROM s WHERE s.theme_id = n.theme_id AND s.book = n.book AND lift > 1) AS last FROM n WHERE k = 1""",
    "linked_rates": f"""WITH lv AS ({K.SQL['link_votes']}), k AS ({K.SQL['kin']}), r AS ({K.SQL['parallel_runs']}), l AS (SELECT DISTINCT least(from_verse, to_verse) AS a, greatest(from_verse, to_verse) AS b FROM lv WHERE from_verse <> to_verse), n AS (SELECT count(DISTINCT verse_id) AS n FROM verses),
      p AS (SELECT 'kin' AS "by", verse_a, verse_b FROM k UNION ALL SELECT 'runs', verse_a, verse_b FROM r) SELECT "by", count(*) AS pairs, count(l.a) AS linked, round(count(l.a) / count(*)::DOUBLE, 6) + 0.0 AS rate, round((SELECT count(*) FROM l) / (any_value(n) * (any_value(n) - 1) / 2.0), 9) + 0.0 AS any_two
      FROM p LEFT JOIN l ON l.a = verse_a AND l.b = verse_b CROSS JOIN n GROUP BY 1""",
    "parsed_ranges": f"""WITH r AS (SELECT DISTINCT reference FROM (SELECT unnest([from_reference, to_reference]) AS reference FROM cross_references) WHERE regexp_matches(reference, {_RR})),
      g AS (SELECT reference, regexp_extract(reference, {_RR}, 1) AS book, regexp_extract(reference, {_RR}, 2)::INT AS chapter, regexp_extract(reference, {_RR}, 3)::INT AS verse, nullif(regexp_extract(reference, {_RR}, 4), '')::INT AS c2, nullif(regexp_extract(reference, {_RR}, 5), '')::INT AS v2 FROM r)
      SELECT reference, book, chapter, verse, coalesce(c2, chapter) AS chapter_end, coalesce(v2, verse) AS verse_end FROM g""",
}
