"""Further operators over the project's tables: compositions of the facts, links, strips and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillmark.functions import measures as M, sequences as Q, text as T
from quillmark.functions.lists import NUMBERS, STOPLIST, sql_list
from quillmark.operators import corpus as C, facts as X, grown as G, judge as J, similarity as S, strips as H, wordsets as W
from quillmark.plans import fact_queries as FQ, link_queries as LQ, style_queries as YQ
from quillmark.plans.fact_queries import _CC, _FR, _RO, _T, _WB, _sub
from quillmark.plans.link_queries import _LN, _PV, _RN
from quillmark.plans.style_queries import _ST
from quillmark.sources.tables import table

R = M.rounded


def kin_within(spark: SparkSession, d: str) -> DataFrame:
    """Kin verses of different chapters of one book."""
    v = C.verses(spark, d).select("verse_id", "book", "chapter")
    k = LQ.kin(spark, d)
    x = k.join(v.select(F.col("verse_id").alias("verse_a"), F.col("book").alias("ba"), F.col("chapter").alias("chapter_a")), "verse_a").join(v.select(F.col("verse_id").alias("verse_b"), F.col("book").alias("bb"), F.col("chapter").alias("chapter_b")), "verse_b")
    return x.where("ba = bb and chapter_a <> chapter_b").select(F.col("ba").alias("book"), "verse_a", "verse_b", "shared", "score")


def kin_linked(spark: SparkSession, d: str) -> DataFrame:
    """Kin pairs, and the votes of a cross reference between them, 0 where none is listed."""
    votes = LQ.link_votes(spark, d).select(F.least("from_verse", "to_verse").alias("verse_a"), F.greatest("from_verse", "to_verse").alias("verse_b"), "votes").groupBy("verse_a", "verse_b").agg(F.max("votes").alias("votes"))
    return LQ.kin(spark, d).join(votes, ["verse_a", "verse_b"], "left").select("verse_a", "verse_b", "shared", F.coalesce("votes", F.lit(0)).alias("votes"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """How two verses that share runs agree: whole, one word changed, same words in another order, a formula, or departing."""
    p = LQ._run_pairs(spark, d).where("book_a <> book_b")
    u = C.units(spark, d).select("verse_id", F.filter("units", lambda w: ~X.is_stop(w)).alias("u"))
    x = p.join(u.select(F.col("verse_id").alias("verse_a"), F.col("u").alias("ua")), "verse_a").join(u.select(F.col("verse_id").alias("verse_b"), F.col("u").alias("ub")), "verse_b")
    return J.verdict(x).select("verse_a", "verse_b", "hits", "verdict")


def bridged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Longest shared run of parallel verses, and how long it grows when one word may differ."""
    p = LQ._run_pairs(spark, d).where("book_a <> book_b").select("verse_a", "verse_b")
    u = C.units(spark, d).select("verse_id", "units")
    x = p.join(u.select(F.col("verse_id").alias("verse_a"), F.col("units").alias("ua")), "verse_a").join(u.select(F.col("verse_id").alias("verse_b"), F.col("units").alias("ub")), "verse_b")
    return x.select("verse_a", "verse_b", Q.common_run("ua", "ub").alias("run"), Q.bridged_run("ua", "ub").alias("bridged"))


def gloss_absorbed(spark: SparkSession, d: str) -> DataFrame:
    """Untagged words that stand beside a tagged word whose gloss names them, with the number they belong to."""
    g = table(spark, d, "lexicon_forms").where("strongs is not null and translit is not null").select(F.col("strongs").alias("mate"), F.lower("translit").alias("word")).distinct()
    w = Window.partitionBy("verse_id").orderBy("position")
    t = C.tokens(spark, d).where("surface is not null").withColumn("tag", F.when(F.col("root").rlike(C.ROOT) & ~F.col("is_stop"), F.col("root")))
    x = t.select(F.lower("surface").alias("word"), "tag", "is_stop", F.lag("tag").over(w).alias("a"), F.lead("tag").over(w).alias("b")).where("tag is null and not is_stop")
    mates = x.select("word", F.explode(F.array_distinct(F.array_compact(F.array("a", "b")))).alias("mate"))
    return mates.join(g, ["mate", "word"]).groupBy("word", "mate").agg(F.count("*").alias("uses"))


def root_genre(spark: SparkSession, d: str) -> DataFrame:
    """The genre that holds the largest share of a root's uses, where that is half or more."""
    g = table(spark, d, "books").where("name is not null").groupBy(F.col("name").alias("book")).agg(F.min("genre").alias("genre"))
    b = X.book_counts(X.chapter_counts(C.content(spark, d))).join(g, "book").where("genre is not null").groupBy("root", "genre").agg(F.sum("weight").alias("w"))
    best = b.groupBy("root").agg(F.min(F.struct((-F.col("w")).alias("k"), "genre")).alias("b"), F.sum("w").alias("total"))
    return best.select("root", F.col("b.genre").alias("genre"), (-F.col("b.k")).alias("uses"), "total").where("uses * 2 >= total")


def spot_summary(spark: SparkSession, d: str) -> DataFrame:
    """Hot and cold spots of each measure by book, with the strongest peak."""
    return YQ.spots(spark, d).groupBy("book", "measure", "hot").agg(F.count("*").alias("spots"), R(F.max(F.abs("peak")), 5).alias("strongest"))


def spot_words(spark: SparkSession, d: str) -> DataFrame:
    """The five commonest roots inside each hot spot."""
    s = YQ.spots(spark, d).where("hot").select("book", "measure", "first", "last")
    v = H.numbered(C.verses(spark, d).where("book is not null")).select("book", "verse_id", "i")
    inside = s.join(v, "book").where("i between first and last").select("book", "measure", "first", "verse_id")
    n = inside.join(C.content(spark, d).select("verse_id", "root"), "verse_id").groupBy("book", "measure", "first", "root").agg(F.count("*").alias("uses"))
    return X.top_k(n, ["book", "measure", "first"], [F.desc("uses"), F.col("root")], 5)


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """Content words of end-to-end stretches of ten verses."""
    v = H.numbered(C.verses(spark, d).where("book is not null")).select("verse_id", "book", F.floor(F.col("i") / 10).alias("tile"))
    n = C.content(spark, d).groupBy("verse_id").agg(F.count("*").alias("n"))
    return v.join(n, "verse_id", "left").groupBy("book", "tile").agg(F.count("*").alias("verses"), F.coalesce(F.sum("n"), F.lit(0)).alias("content"))


def book_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Rank of each book by its share of each root's uses; roots of 20 uses or more."""
    b = X.book_counts(X.chapter_counts(C.content(spark, d))).select("book", "root", "weight")
    kept = b.groupBy("root").agg(F.sum("weight").alias("total")).where("total >= 20")
    return b.join(kept, "root").select("root", "book", "weight", F.rank().over(Window.partitionBy("root").orderBy(F.desc("weight"))).alias("rank"))


def layer_difference(spark: SparkSession, d: str) -> DataFrame:
    """Verses of each passage's testament outside the passage: its baseline."""
    b = C.books(spark, d).select("book", "testament")
    v = C.verses(spark, d).join(b, "book").select("verse_id", "testament")
    size = v.groupBy("testament").agg(F.count("*").alias("size"))
    own = LQ.passage_verses(spark, d).join(v, "verse_id").groupBy("passage_id", "testament").agg(F.count("*").alias("own"))
    return own.join(size, "testament").select("passage_id", "testament", "own", (F.col("size") - F.col("own")).alias("baseline"))


def within_echoes(spark: SparkSession, d: str) -> DataFrame:
    """Formulas of three words or more that chapters of one book share; refrains, in three chapters or more, apart."""
    r = X.formulas(C.units(spark, d), (3, 4, 5)).where(X.substance(F.col("wording")))
    c = r.select("phrase", "book", "chapter").distinct().groupBy("phrase", "book").agg(F.count("*").alias("chapters"), F.min("chapter").alias("chapter_a"), F.max("chapter").alias("chapter_b"))
    return c.where("chapters >= 2").select("book", "phrase", "chapters", "chapter_a", "chapter_b", (F.col("chapters") >= 3).alias("refrain"))


def cited_roots(spark: SparkSession, d: str) -> DataFrame:
    """Listed verse links whose verses share a rare root, with the rarest."""
    c = C.content(spark, d)
    rare = c.select("verse_id", "root").distinct().join(S.rare_roots(C.tokens(spark, d), C.books(spark, d), 500), "root")
    v = LQ.link_votes(spark, d).where("votes >= 2")
    a = v.join(rare.select(F.col("verse_id").alias("from_verse"), "root", "rarity"), "from_verse")
    b = a.join(rare.select(F.col("verse_id").alias("to_verse"), "root"), ["to_verse", "root"])
    return b.groupBy("from_verse", "to_verse").agg(F.count("*").alias("roots"), F.max("votes").alias("votes"), R(F.max("rarity")).alias("rarest"))


def books_against_layer(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of roots together in a book's verses at three times the rate of its testament's, in eight verses or more."""
    b = C.books(spark, d).select("book", "testament")
    u = C.content(spark, d).join(b, "book").select("testament", "book", "verse_id", "root").distinct()
    keep = u.groupBy("root").agg(F.count("*").alias("s")).where("s >= 20").orderBy(F.desc("s"), "root").limit(600).select("root")
    sets = u.join(keep, "root", "left_semi").groupBy("testament", "book", "verse_id").agg(F.sort_array(F.collect_list("root")).alias("r"))
    first = sets.select("testament", "book", "r", F.posexplode("r").alias("i", "root_a"))
    n = first.select("testament", "book", "root_a", F.explode(F.slice("r", F.col("i") + 2, F.size("r"))).alias("root_b")).groupBy("testament", "book", "root_a", "root_b").agg(F.count("*").alias("n"))
    layer = n.groupBy("testament", "root_a", "root_b").agg(F.sum("n").alias("all_n"))
    size = u.select("testament", "book", "verse_id").distinct().groupBy("testament", "book").agg(F.count("*").alias("size"))
    total = size.groupBy("testament").agg(F.sum("size").alias("layer_size"))
    x = n.where("n >= 8").join(layer, ["testament", "root_a", "root_b"]).join(size, ["testament", "book"]).join(total, "testament")
    return x.where("n * layer_size >= 3 * all_n * size").select("book", "root_a", "root_b", "n", "all_n")


def books_against_layer_all(spark: SparkSession, d: str) -> DataFrame:
    """As ``books_against_layer``, whose SQL has the pairs of 600 roots, with all sets of two to five roots of 20 verses or more. A set in eight verses of a book is in eight of all."""
    b = C.books(spark, d).select("book", "testament")
    u = C.content(spark, d).join(b, "book").select("testament", "book", F.col("verse_id").alias("unit"), "root").distinct()
    words, at = u.select("unit", "root"), u.select("testament", "book", "unit").distinct()
    n = G.of_books(G.by_root(words, W.vocabulary(words, 20, None), at, ["testament", "book"]), 8, 5)
    size = at.groupBy("testament", "book").agg(F.count("*").alias("size"))
    total = size.groupBy("testament").agg(F.sum("size").alias("layer_size"))
    x = n.join(size, ["testament", "book"]).join(total, "testament")
    return x.where("n * layer_size >= 3 * all_n * size").select("book", "members", "n", "all_n")


def formula_spans(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping formulas of a verse as one span: where a verse speaks in formulas, and how much of it."""
    u = C.units(spark, d)
    rows = u.where("size(units) = size(words)").select("verse_id", F.size("units").alias("m"), "units", "words")
    starts = F.flatten(F.transform(F.array(*(F.lit(k) for k in (2, 3, 4, 5))), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.col("m"), F.lit(1))), lambda i: i + n - 1 <= F.col("m")), lambda i: F.struct(i.alias("i"), n.alias("n")))))
    r = rows.select("verse_id", "m", "units", "words", F.explode(starts).alias("s")).where(~X.is_stop(F.element_at("words", F.col("s.i") + F.col("s.n") - 1)))
    r = r.select("verse_id", "m", F.col("s.i").alias("lo"), (F.col("s.i") + F.col("s.n") - 1).alias("hi"), F.array_join(F.slice("units", F.col("s.i"), F.col("s.n")), " ").alias("phrase"))
    known = r.groupBy("phrase").agg(F.count_distinct("verse_id").alias("v")).where("v >= 2").select("phrase")
    w = Window.partitionBy("verse_id").orderBy("lo", "hi")
    k = r.join(known, "phrase", "left_semi").select("verse_id", "m", "lo", "hi")
    k = k.withColumn("new", F.coalesce(F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(w))
    s = k.groupBy("verse_id", "m", "span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return s.groupBy("verse_id", F.col("m").alias("units")).agg(F.count("*").alias("spans"), F.sum(F.col("hi") - F.col("lo") + 1).cast("long").alias("covered"))


def word_list_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of the units of a theme's core verses that are its telling roots: those four times as frequent there as in all the text."""
    t = table(spark, d, "theme_verse").where("theme_id is not null and role = 'core' and verse_id is not null").select("theme_id", "verse_id").distinct()
    c = C.content(spark, d).groupBy("verse_id", "root").agg(F.count("*").alias("n"))
    w = c.groupBy("root").agg(F.sum("n").alias("w"))
    x = t.join(c, "verse_id").groupBy("theme_id", "root").agg(F.sum("n").alias("n"))
    size = x.groupBy("theme_id").agg(F.sum("n").alias("size"))
    x = x.join(w, "root").join(size, "theme_id").withColumn("every", w.agg(F.sum("w")).scalar())
    x = x.withColumn("tells", (F.col("n") >= 2) & (F.col("n") * F.col("every") >= 4 * F.col("w") * F.col("size")))
    return x.groupBy("theme_id").agg(F.count_if(F.col("tells")).alias("roots"), R(F.sum(F.when(F.col("tells"), F.col("n")).otherwise(0)) / F.max("size")).alias("share"))


def telling_words(spark: SparkSession, d: str) -> DataFrame:
    """The ten roots that tell most of each testament: weight there times the share of all its uses there."""
    b = C.books(spark, d).where("testament is not null").select("book", "testament")
    n = X.book_counts(X.chapter_counts(C.content(spark, d))).join(b, "book").groupBy("testament", "root").agg(F.sum("weight").alias("w"))
    total = n.groupBy("root").agg(F.sum("w").alias("t"))
    x = n.join(total, "root").withColumn("tells", R(F.col("w") * F.col("w") / F.col("t")))
    return X.top_k(x, ["testament"], [F.desc("tells"), F.col("root")], 10).select("testament", "rank", "root", "tells")


def seam_check(spark: SparkSession, d: str) -> DataFrame:
    """For each chapter where a theme begins or ends, the share of chapters of the book that shift less."""
    seams = _theme_seams(spark, d)
    s = YQ.chapter_shifts(spark, d)
    c = s.groupBy("book", "distance").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("book").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = c.withColumn("below", below).join(s.groupBy("book").agg(F.count("*").alias("all")), "book").select("book", "distance", R(M.mid_rank("below", "n", "all")).alias("percentile"))
    return seams.join(s, ["book", "chapter"]).join(p, ["book", "distance"]).select("book", "chapter", "percentile")


def _theme_seams(spark: SparkSession, d: str) -> DataFrame:
    t = LQ.theme_strip(spark, d).groupBy("theme_id", "book").agg(F.min("chapter").alias("a"), F.max("chapter").alias("b"))
    return t.select("book", F.explode(F.array("a", "b")).alias("chapter")).distinct()


def part_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of the two halves of a verse in their parts of speech: common subsequence over the longer half."""
    t = C.tokens(spark, d).where("morph is not null").select("verse_id", "position", T.part_of_speech("morph").alias("p")).where("p is not null")
    v = t.groupBy("verse_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "p"))), lambda x: x["p"]).alias("p")).where("size(p) >= 4")
    half = F.floor(F.size("p") / 2).cast("int")
    h = v.select("verse_id", F.slice("p", 1, half).alias("a"), F.slice("p", half + 1, F.size("p") - half).alias("b"))
    return h.select("verse_id", R(Q.lcs("a", "b") / F.greatest(F.size("a"), F.size("b"))).alias("likeness"))


def scoped_forms(spark: SparkSession, d: str) -> DataFrame:
    """The spelling to show for a root in a chapter: its commonest there if used twice, else in the book, else in all the text."""
    c = C.content(spark, d).where("surface is not null")
    here = X.commonest(c, ["book", "chapter", "root"], "surface").select("book", "chapter", "root", F.col("surface").alias("s1"), "total")
    book = X.commonest(c, ["book", "root"], "surface").select("book", "root", F.col("surface").alias("s2"), F.col("total").alias("t2"))
    every = X.commonest(c, ["root"], "surface").select("root", F.col("surface").alias("s3"))
    x = here.join(book, ["book", "root"]).join(every, "root")
    return x.select("book", "chapter", "root", F.coalesce(F.when(F.col("total") >= 2, F.col("s1")), F.when(F.col("t2") >= 2, F.col("s2")), F.col("s3")).alias("surface"))


def lexicon_display(spark: SparkSession, d: str) -> DataFrame:
    """Each used root with its number, commonest form, script and gloss."""
    x = table(spark, d, "lexicon_forms").where("strongs is not null").groupBy(F.col("strongs").alias("root")).agg(F.min("script").alias("script"), F.min("translit").alias("gloss"))
    f = FQ.common_form(spark, d).select("root", "surface", "uses")
    return f.join(x, "root").select("root", F.concat_ws(" ", "surface", "root", "script").alias("shown"), "gloss", "uses")


def language_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Verses of each language by book and chapter, where a chapter has more than one."""
    v = C.verses(spark, d).where("book is not null and language is not null")
    n = v.groupBy("book", "chapter", "language").agg(F.count("*").alias("verses"))
    many = n.groupBy("book", "chapter").agg(F.count("*").alias("k")).where("k > 1").select("book", "chapter")
    return n.join(many, ["book", "chapter"], "left_semi")


def lemma_votes(spark: SparkSession, d: str) -> DataFrame:
    """Lemmas with one number, and whether most of their uses are function words."""
    t = C.tokens(spark, d).where("lemma is not null and root is not null")
    n = t.groupBy("lemma").agg(F.count_distinct("root").alias("roots"), F.min("root").alias("root"), F.count("*").alias("uses"), F.count_if(F.col("is_stop")).alias("stops"))
    return n.where("roots = 1").select("lemma", "root", "uses", (F.col("stops") * 2 > F.col("uses")).alias("is_stop"))


def attested_forms(spark: SparkSession, d: str) -> DataFrame:
    """Script to show for a number: the dictionary form where its share reaches a fifth or no share is known, else the commonest lemma of the text."""
    x = table(spark, d, "lexicon_forms").where("strongs is not null and script is not null").groupBy(F.col("strongs").alias("root")).agg(F.min("script").alias("script"), F.max("attested_share").alias("share"))
    c = X.commonest(C.content(spark, d).where("lemma is not null"), ["root"], "lemma").select("root", "lemma")
    return x.join(c, "root", "left").select("root", F.when(F.col("share").isNull() | (F.col("share") >= 0.2), F.col("script")).otherwise(F.coalesce("lemma", "script")).alias("form"))


def corrected_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """Corrections of lemmas, and whether they change the lexicon's form."""
    k = table(spark, d, "lemma_corrections").where("strongs is not null and lemma is not null").select("strongs", "lemma").distinct()
    x = table(spark, d, "lexicon_forms").where("strongs is not null and script is not null").groupBy("strongs").agg(F.min("script").alias("script"))
    return k.join(x, "strongs", "left").select("strongs", "lemma", F.coalesce(F.col("lemma") != F.col("script"), F.lit(True)).alias("changes"))


def small_groups(spark: SparkSession, d: str) -> DataFrame:
    """Baseline groups with fewer than three books: too small to be a norm."""
    return C.books(spark, d).where("baseline_group is not null").groupBy("testament", "baseline_group").agg(F.count("*").alias("books")).where("books < 3")


def cross_layer_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between verses by the testaments they join, against what their sizes let expect."""
    b = C.books(spark, d).select("book", "testament")
    v = C.verses(spark, d).join(b, "book").select("verse_id", "testament")
    n = LQ.link_votes(spark, d).join(v.select(F.col("verse_id").alias("from_verse"), F.col("testament").alias("a")), "from_verse").join(v.select(F.col("verse_id").alias("to_verse"), F.col("testament").alias("b")), "to_verse").groupBy("a", "b").agg(F.count("*").alias("links"))
    size = v.groupBy("testament").agg(F.count("*").alias("size"))
    size = size.withColumn("every", size.agg(F.sum("size")).scalar())
    total = n.groupBy("a").agg(F.sum("links").alias("total"))
    return n.join(total, "a").join(size.select(F.col("testament").alias("b"), "size", "every"), "b").select("a", "b", "links", R(F.col("total") * F.col("size") / F.col("every")).alias("expected"))


def pair_weights(spark: SparkSession, d: str) -> DataFrame:
    """Verses of one chapter by the rarity of the roots they share: what structure tests weigh."""
    c = C.content(spark, d).select("book", "chapter", "verse_id", "root").distinct()
    df = c.groupBy("root").agg(F.count("*").alias("df")).withColumn("n", c.agg(F.count_distinct("verse_id")).scalar()).select("root", F.log(F.col("n") / F.col("df")).alias("idf"))
    sets = c.join(df, "root").groupBy("book", "chapter", "root", "idf").agg(F.sort_array(F.collect_list("verse_id")).alias("v"))
    first = sets.select("idf", "v", F.posexplode("v").alias("i", "verse_a"))
    return first.select("idf", "verse_a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("verse_b")).groupBy("verse_a", "verse_b").agg(F.count("*").alias("shared"), R(F.sum("idf")).alias("weight"))


def passage_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Passages as stretches of verses without a gap, in the order of the book."""
    v = H.numbered(C.verses(spark, d).where("book is not null")).select("verse_id", "book", "i")
    w = Window.partitionBy("passage_id", "book").orderBy("i")
    x = LQ.passage_verses(spark, d).join(v, "verse_id").withColumn("g", F.col("i") - F.row_number().over(w))
    return x.groupBy("passage_id", "book", "g").agg(F.min("i").alias("first"), F.count("*").alias("verses")).drop("g")


def citation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cross references by the book they leave and how they score."""
    r = table(spark, d, "cross_references").select("id", F.trim(F.lower("from_book")).alias("from_book"), "relevance_score").distinct()
    return r.groupBy("from_book").agg(F.count("*").alias("links"), F.count_if(F.col("relevance_score") < 0).alias("declined"), F.max("relevance_score").alias("best"))


def parsing_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.content(spark, d).where("morph is not null").groupBy("root", "morph").agg(F.count("*").alias("uses"))


def book_codes(spark: SparkSession, d: str) -> DataFrame:
    """Books with their codes, and chapters and verses they have in the text."""
    b = table(spark, d, "books").where("name is not null").groupBy(F.col("name").alias("book")).agg(F.min("abbreviation").alias("code"))
    v = C.verses(spark, d).groupBy("book").agg(F.count_distinct("chapter").alias("chapters"), F.count("*").alias("verses"))
    return b.join(v, "book", "left").select("book", "code", F.coalesce("chapters", F.lit(0)).alias("chapters"), F.coalesce("verses", F.lit(0)).alias("verses"))


def part_words(spark: SparkSession, d: str) -> DataFrame:
    """Keyness of the words of part names by brand: the measure on other tables."""
    p = table(spark, d, "part").select("p_brand", F.explode(F.split(F.lower("p_name"), " ")).alias("word")).where("word <> ''").groupBy("p_brand", "word").agg(F.count("*").alias("n"))
    brand = p.groupBy("p_brand").agg(F.sum("n").alias("size"))
    word = p.groupBy("word").agg(F.sum("n").alias("total"))
    x = p.join(brand, "p_brand").join(word, "word").withColumn("every", p.agg(F.sum("n")).scalar())
    return x.select("p_brand", "word", "n", R(M.g2("n", F.col("total") - F.col("n"), "size", F.col("every") - F.col("size"))).alias("keyness"))


def market_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Brands bought in one order: pairs with their number of orders."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    sets = li.select("l_orderkey", "p_brand").distinct().groupBy("l_orderkey").agg(F.sort_array(F.collect_list("p_brand")).alias("b"))
    first = sets.groupBy("b").agg(F.count("*").alias("w")).select("b", "w", F.posexplode("b").alias("i", "brand_a"))
    return first.select("w", "brand_a", F.explode(F.slice("b", F.col("i") + 2, F.size("b"))).alias("brand_b")).groupBy("brand_a", "brand_b").agg(F.sum("w").alias("orders"))


def region_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Orders and their worth by region and priority: joins of the catalogue tables."""
    t = lambda n: table(spark, d, n)
    x = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("worth"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    v = LQ.link_votes(spark, d).select(F.least("from_verse", "to_verse").alias("verse_a"), F.greatest("from_verse", "to_verse").alias("verse_b"), "votes")
    return v.groupBy("verse_a", "verse_b").agg(F.max("votes").alias("votes"))


def clause_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of verses by the rarity of the rare roots they share and two points for each run of four units."""
    runs = LQ._run_pairs(spark, d).select("verse_a", "verse_b", "hits")
    k = LQ.kin(spark, d)
    x = k.join(runs, ["verse_a", "verse_b"], "full")
    return x.select("verse_a", "verse_b", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("hits", F.lit(0)).alias("hits"), R(F.coalesce("score", F.lit(0.0)) + 2 * F.coalesce("hits", F.lit(0))).alias("score"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Listed or found pairs of verses, by what speaks for them: quotation (runs, listed), echo (runs), allusion (rare roots, listed), kin (rare roots), listed (nothing found)."""
    x = clause_scores(spark, d).join(_votes(spark, d), ["verse_a", "verse_b"], "full")
    hits, shared, votes = (F.coalesce(c, F.lit(0)) for c in ("hits", "shared", "votes"))
    kind = F.when((hits > 0) & (votes > 0), "quotation").when(hits > 0, "echo").when((shared > 0) & (votes > 0), "allusion").when(shared > 0, "kin").otherwise("listed")
    return x.select("verse_a", "verse_b", kind.alias("kind"))


def rival_check(spark: SparkSession, d: str) -> DataFrame:
    """For each verse with kin: its closest kin, and whether a cross reference lists that pair or only a weaker one."""
    k = LQ.kin(spark, d).join(_votes(spark, d), ["verse_a", "verse_b"], "left").select("verse_a", "verse_b", "score", (F.coalesce("votes", F.lit(0)) > 0).alias("listed"))
    both = k.unionByName(k.select(F.col("verse_b").alias("verse_a"), F.col("verse_a").alias("verse_b"), "score", "listed"))
    any_listed = both.groupBy("verse_a").agg(F.bool_or("listed").alias("any"))
    top = X.top_k(both, ["verse_a"], [F.desc("score"), F.col("verse_b")], 1)
    return top.join(any_listed, "verse_a").select("verse_a", "verse_b", F.when(F.col("listed"), "listed").when(F.col("any"), "rival").otherwise("unlisted").alias("standing"))


def number_words(spark: SparkSession, d: str) -> DataFrame:
    """Number words of each book, with the rate per thousand words."""
    t = C.tokens(spark, d).groupBy("book").agg(F.count("*").alias("words"), F.count_if(F.lower("surface").isin(*NUMBERS)).alias("numbers"))
    return t.select("book", "words", "numbers", M.per_thousand("numbers", "words").alias("per_thousand"))


def station_words(spark: SparkSession, d: str) -> DataFrame:
    """Uses in each passage of the roots that mark its book: how many words, and how many different ones."""
    key = FQ.word_book(spark, d).where("keyness >= 10.83").select("book", "root")
    c = C.content(spark, d).groupBy("verse_id", "book", "root").agg(F.count("*").alias("n")).join(key, ["book", "root"])
    return LQ.passage_verses(spark, d).join(c, "verse_id").groupBy("passage_id").agg(F.sum("n").alias("words"), F.count_distinct("book", "root").alias("roots"))


_stop = sql_list(STOPLIST)
_RUNS = _RN[len(_T) :].lstrip(", ")
_KIN = f"""{_LN}, {_RO}, kr AS (SELECT root, rarity FROM ro WHERE w * 2000 <= n),
kv AS (SELECT DISTINCT verse_id, root, rarity FROM ct JOIN kr USING (root)), kn AS (SELECT a.verse_id AS verse_a, b.verse_id AS verse_b, count(*)::INT AS shared, round(sum(a.rarity), 6) + 0.0 AS score FROM kv a JOIN kv b ON a.root = b.root AND a.verse_id < b.verse_id GROUP BY 1, 2 HAVING count(*) >= 3)
"""
_CS = f"""{_KIN}, {_RUNS}, cs AS (SELECT coalesce(kn.verse_a, rp.verse_a) AS verse_a, coalesce(kn.verse_b, rp.verse_b) AS verse_b, coalesce(shared, 0) AS shared, coalesce(hits, 0) AS hits, round(coalesce(score, 0) + 2 * coalesce(hits, 0), 6) + 0.0 AS score
  FROM kn FULL JOIN rp ON kn.verse_a = rp.verse_a AND kn.verse_b = rp.verse_b),
vo AS (SELECT least(from_verse, to_verse) AS verse_a, greatest(from_verse, to_verse) AS verse_b, max(votes) AS votes FROM lv GROUP BY 1, 2)
"""

QUERIES = {
    f.__name__: f
    for f in (kin_within, kin_linked, verdicts, bridged_runs, gloss_absorbed, root_genre, spot_summary, spot_words, tiles, book_ranks, layer_difference, within_echoes, cited_roots, books_against_layer, formula_spans, word_list_shares, telling_words, seam_check, part_likeness,
              scoped_forms, lexicon_display, language_chapters, lemma_votes, attested_forms, corrected_lemmas, small_groups, cross_layer_links, pair_weights, books_against_layer_all, clause_scores, evidence, rival_check, number_words, station_words, passage_stretches, citation_counts, parsing_counts, book_codes, part_words, market_baskets, region_revenue)
}

SQL = {
    "kin_within": f"{_KIN} SELECT x.book, verse_a, verse_b, shared, score FROM kn JOIN vb x ON x.verse_id = verse_a JOIN vb y ON y.verse_id = verse_b WHERE x.book = y.book AND x.chapter <> y.chapter",
    "kin_linked": f"{_KIN}, vo AS (SELECT least(from_verse, to_verse) AS verse_a, greatest(from_verse, to_verse) AS verse_b, max(votes) AS votes FROM lv GROUP BY 1, 2) SELECT verse_a, verse_b, shared, coalesce(votes, 0) AS votes FROM kn LEFT JOIN vo USING (verse_a, verse_b)",
    "gloss_absorbed": f"""{_T}, g AS (SELECT DISTINCT strongs AS mate, lower(translit) AS word FROM lexicon_forms WHERE strongs IS NOT NULL AND translit IS NOT NULL), t AS (SELECT verse_id, position, lower(surface) AS word, is_stop, CASE WHEN regexp_matches(root, '^[HG]\\d+$') AND NOT is_stop THEN root END AS tag FROM tk WHERE surface IS NOT NULL),
      x AS (SELECT *, lag(tag) OVER w AS a, lead(tag) OVER w AS b FROM t WINDOW w AS (PARTITION BY verse_id ORDER BY position)), m AS (SELECT word, a AS mate FROM x WHERE tag IS NULL AND NOT is_stop AND a IS NOT NULL UNION ALL SELECT word, b FROM x WHERE tag IS NULL AND NOT is_stop AND b IS NOT NULL AND b IS DISTINCT FROM a)
      SELECT word, mate, count(*) AS uses FROM m JOIN g USING (word, mate) GROUP BY 1, 2""",
    "root_genre": f"""{_CC}, g AS (SELECT name AS book, min(genre) AS genre FROM books WHERE name IS NOT NULL GROUP BY 1), b AS (SELECT root, genre, sum(weight)::BIGINT AS w FROM bc JOIN g USING (book) WHERE genre IS NOT NULL GROUP BY 1, 2)
      SELECT root, genre, w AS uses, total FROM (SELECT *, (sum(w) OVER (PARTITION BY root))::BIGINT AS total, row_number() OVER (PARTITION BY root ORDER BY w DESC, genre) AS k FROM b) WHERE k = 1 AND w * 2 >= total""",
    "spot_summary": f"SELECT book, measure, hot, count(*) AS spots, round(max(abs(peak)), 5) + 0.0 AS strongest FROM ({YQ.SQL['spots']}) GROUP BY 1, 2, 3",
    "spot_words": f"""{_ST}, sp2 AS (SELECT * FROM ({YQ.SQL['spots'].replace(_ST, 'WITH dummy AS (SELECT 1)', 1)}) WHERE hot), n AS (SELECT s.book, measure, first, root, count(*) AS uses FROM sp2 s JOIN v ON v.book = s.book AND v.i BETWEEN first AND last JOIN ct USING (verse_id) GROUP BY 1, 2, 3, 4)
      SELECT book, measure, first, root, uses, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY book, measure, first ORDER BY uses DESC, root) AS rank FROM n) WHERE rank <= 5""",
    "tiles": f"""{_T}, v AS (SELECT verse_id, book, (row_number() OVER (PARTITION BY book ORDER BY chapter, verse, verse_id) - 1) // 10 AS tile FROM vb WHERE book IS NOT NULL), n AS (SELECT verse_id, count(*) AS n FROM ct GROUP BY 1)
      SELECT book, tile, count(*) AS verses, coalesce(sum(n), 0)::BIGINT AS content FROM v LEFT JOIN n USING (verse_id) GROUP BY 1, 2""",
    "book_ranks": f"{_CC}, k AS (SELECT root FROM bc GROUP BY 1 HAVING sum(weight) >= 20) SELECT root, book, weight, (rank() OVER (PARTITION BY root ORDER BY weight DESC))::INT AS rank FROM bc WHERE root IN (SELECT root FROM k)",
    "layer_difference": f"""{_PV}, v AS (SELECT verse_id, testament FROM vb JOIN bk USING (book)), z AS (SELECT testament, count(*) AS size FROM v GROUP BY 1), o AS (SELECT passage_id, testament, count(*) AS own FROM pv JOIN v USING (verse_id) GROUP BY 1, 2)
      SELECT passage_id, testament, own, size - own AS baseline FROM o JOIN z USING (testament)""",
    "within_echoes": f"""{_FR}, c AS (SELECT DISTINCT phrase, book, chapter FROM fr WHERE n >= 3 AND {_sub('wording')}) SELECT book, phrase, count(*) AS chapters, min(chapter) AS chapter_a, max(chapter) AS chapter_b, count(*) >= 3 AS refrain FROM c GROUP BY 1, 2 HAVING count(*) >= 2""",
    "cited_roots": f"""{_LN}, {_RO}, r AS (SELECT root, rarity FROM ro WHERE w * 500 <= n), q AS (SELECT DISTINCT verse_id, root, rarity FROM ct JOIN r USING (root))
      SELECT from_verse, to_verse, count(*) AS roots, max(votes) AS votes, round(max(a.rarity), 6) + 0.0 AS rarest FROM lv JOIN q a ON a.verse_id = from_verse JOIN q b ON b.verse_id = to_verse AND b.root = a.root WHERE votes >= 2 GROUP BY 1, 2""",
    "books_against_layer": f"""{_T}, u AS (SELECT DISTINCT testament, book, verse_id, root FROM ct JOIN bk USING (book)), k AS (SELECT root FROM u GROUP BY 1 HAVING count(*) >= 20 ORDER BY count(*) DESC, root LIMIT 600), f AS (SELECT * FROM u WHERE root IN (SELECT root FROM k)),
      n AS (SELECT a.testament, a.book, a.root AS root_a, b.root AS root_b, count(*) AS n FROM f a JOIN f b ON a.verse_id = b.verse_id AND a.root < b.root GROUP BY 1, 2, 3, 4), l AS (SELECT testament, root_a, root_b, sum(n)::BIGINT AS all_n FROM n GROUP BY 1, 2, 3),
      z AS (SELECT testament, book, count(DISTINCT verse_id) AS size FROM u GROUP BY 1, 2), t AS (SELECT testament, sum(size) AS ls FROM z GROUP BY 1)
      SELECT book, root_a, root_b, n, all_n FROM n JOIN l USING (testament, root_a, root_b) JOIN z USING (testament, book) JOIN t USING (testament) WHERE n >= 8 AND n * ls >= 3 * all_n * size""",
    "formula_spans": f"""{_T}, nn AS (SELECT unnest([2, 3, 4, 5]) AS n), s AS (SELECT verse_id, len(units) AS m, units, words, n, unnest(range(1, len(units) - n + 2)) AS lo FROM un CROSS JOIN nn WHERE len(units) = len(words) AND len(units) >= n),
      r AS (SELECT verse_id, m, lo, lo + n - 1 AS hi, array_to_string(list_slice(units, lo, lo + n - 1), ' ') AS phrase FROM s WHERE words[lo + n - 1] NOT IN {_stop}), k AS (SELECT phrase FROM r GROUP BY 1 HAVING count(DISTINCT verse_id) >= 2),
      o AS (SELECT verse_id, m, lo, hi, CASE WHEN lo <= max(hi) OVER (PARTITION BY verse_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r WHERE phrase IN (SELECT phrase FROM k)),
      g AS (SELECT *, sum(new) OVER (PARTITION BY verse_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS span FROM o), h AS (SELECT verse_id, m, span, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY 1, 2, 3)
      SELECT verse_id, m::INT AS units, count(*) AS spans, sum(hi - lo + 1)::BIGINT AS covered FROM h GROUP BY 1, 2""",
    "word_list_shares": f"""{_T}, t AS (SELECT DISTINCT theme_id, verse_id FROM theme_verse WHERE theme_id IS NOT NULL AND role = 'core' AND verse_id IS NOT NULL), w AS (SELECT root, count(*) AS w FROM ct GROUP BY 1), x AS (SELECT theme_id, root, count(*) AS n FROM t JOIN ct USING (verse_id) GROUP BY 1, 2),
      z AS (SELECT theme_id, sum(n) AS size FROM x GROUP BY 1), y AS (SELECT theme_id, n, size, n >= 2 AND n * (SELECT sum(w) FROM w) >= 4 * w * size AS tells FROM x JOIN w USING (root) JOIN z USING (theme_id))
      SELECT theme_id, count(*) FILTER (tells) AS roots, round(coalesce(sum(n) FILTER (tells), 0) / max(size)::DOUBLE, 6) + 0.0 AS share FROM y GROUP BY 1""",
    "telling_words": f"""{_CC}, n AS (SELECT testament, root, sum(weight) AS w FROM bc JOIN bk USING (book) WHERE testament IS NOT NULL GROUP BY 1, 2), x AS (SELECT testament, root, round(w * w / (sum(w) OVER (PARTITION BY root))::DOUBLE, 6) + 0.0 AS tells FROM n)
      SELECT testament, rank::INT AS rank, root, tells FROM (SELECT *, row_number() OVER (PARTITION BY testament ORDER BY tells DESC, root) AS rank FROM x) WHERE rank <= 10""",
    "scoped_forms": f"""{_T}, c AS (SELECT * FROM ct WHERE surface IS NOT NULL), h AS (SELECT book, chapter, root, surface, count(*) AS n FROM c GROUP BY 1, 2, 3, 4),
      a AS (SELECT book, chapter, root, surface AS s1, t AS t1 FROM (SELECT *, sum(n) OVER (PARTITION BY book, chapter, root) AS t, row_number() OVER (PARTITION BY book, chapter, root ORDER BY n DESC, surface) AS k FROM h) WHERE k = 1),
      b AS (SELECT book, root, surface AS s2, t AS t2 FROM (SELECT book, root, surface, sum(sum(n)) OVER (PARTITION BY book, root) AS t, row_number() OVER (PARTITION BY book, root ORDER BY sum(n) DESC, surface) AS k FROM h GROUP BY 1, 2, 3) WHERE k = 1),
      e AS (SELECT root, surface AS s3 FROM (SELECT root, surface, row_number() OVER (PARTITION BY root ORDER BY sum(n) DESC, surface) AS k FROM h GROUP BY 1, 2) WHERE k = 1)
      SELECT book, chapter, root, CASE WHEN t1 >= 2 THEN s1 WHEN t2 >= 2 THEN s2 ELSE s3 END AS surface FROM a JOIN b USING (book, root) JOIN e USING (root)""",
    "lexicon_display": f"""{_T}, x AS (SELECT strongs AS root, min(script) AS script, min(translit) AS gloss FROM lexicon_forms WHERE strongs IS NOT NULL GROUP BY 1), f AS (SELECT root, surface, count(*) AS uses FROM ct WHERE surface IS NOT NULL GROUP BY 1, 2),
      b AS (SELECT root, surface, uses FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY uses DESC, surface) AS k FROM f) WHERE k = 1) SELECT root, concat_ws(' ', surface, root, script) AS shown, gloss, uses FROM b JOIN x USING (root)""",
    "language_chapters": f"""{_T}, n AS (SELECT book, chapter, language, count(*) AS verses FROM vb WHERE book IS NOT NULL AND language IS NOT NULL GROUP BY 1, 2, 3) SELECT * FROM n WHERE (book, chapter) IN (SELECT (book, chapter) FROM n GROUP BY book, chapter HAVING count(*) > 1)""",
    "lemma_votes": f"""{_T} SELECT lemma, min(root) AS root, count(*) AS uses, count(*) FILTER (is_stop) * 2 > count(*) AS is_stop FROM tk WHERE lemma IS NOT NULL AND root IS NOT NULL GROUP BY 1 HAVING count(DISTINCT root) = 1""",
    "attested_forms": f"""{_T}, x AS (SELECT strongs AS root, min(script) AS script, max(attested_share) AS share FROM lexicon_forms WHERE strongs IS NOT NULL AND script IS NOT NULL GROUP BY 1), f AS (SELECT root, lemma, count(*) AS n FROM ct WHERE lemma IS NOT NULL GROUP BY 1, 2),
      b AS (SELECT root, lemma FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, lemma) AS k FROM f) WHERE k = 1) SELECT root, CASE WHEN share IS NULL OR share >= 0.2 THEN script ELSE coalesce(lemma, script) END AS form FROM x LEFT JOIN b USING (root)""",
    "corrected_lemmas": """WITH k AS (SELECT DISTINCT strongs, lemma FROM lemma_corrections WHERE strongs IS NOT NULL AND lemma IS NOT NULL), x AS (SELECT strongs, min(script) AS script FROM lexicon_forms WHERE strongs IS NOT NULL AND script IS NOT NULL GROUP BY 1)
      SELECT strongs, lemma, coalesce(lemma <> script, true) AS changes FROM k LEFT JOIN x USING (strongs)""",
    "small_groups": f"{_T} SELECT testament, baseline_group, count(*) AS books FROM bk WHERE baseline_group IS NOT NULL GROUP BY 1, 2 HAVING count(*) < 3",
    "cross_layer_links": f"""{_LN}, v AS (SELECT verse_id, testament FROM vb JOIN bk USING (book)), n AS (SELECT x.testament AS a, y.testament AS b, count(*) AS links FROM lv JOIN v x ON x.verse_id = from_verse JOIN v y ON y.verse_id = to_verse GROUP BY 1, 2), z AS (SELECT testament, count(*) AS size FROM v GROUP BY 1)
      SELECT a, b, links, round((sum(links) OVER (PARTITION BY a)) * size / (SELECT sum(size) FROM z)::DOUBLE, 6) + 0.0 AS expected FROM n JOIN z ON z.testament = b""",
    "pair_weights": f"""{_T}, c AS (SELECT DISTINCT book, chapter, verse_id, root FROM ct), f AS (SELECT root, ln((SELECT count(DISTINCT verse_id) FROM c) / count(*)::DOUBLE) AS idf FROM c GROUP BY 1)
      SELECT a.verse_id AS verse_a, b.verse_id AS verse_b, count(*) AS shared, round(sum(idf), 6) + 0.0 AS weight FROM c a JOIN c b ON a.book = b.book AND a.chapter = b.chapter AND a.root = b.root AND a.verse_id < b.verse_id JOIN f ON f.root = a.root GROUP BY 1, 2""",
    "passage_stretches": f"""{_PV}, v AS (SELECT verse_id, book, row_number() OVER (PARTITION BY book ORDER BY chapter, verse, verse_id) - 1 AS i FROM vb WHERE book IS NOT NULL), x AS (SELECT passage_id, book, i, i - row_number() OVER (PARTITION BY passage_id, book ORDER BY i) AS g FROM pv JOIN v USING (verse_id))
      SELECT passage_id, book, min(i) AS first, count(*) AS verses FROM x GROUP BY passage_id, book, g""",
    "clause_scores": f"{_CS} SELECT * FROM cs",
    "evidence": f"""{_CS} SELECT coalesce(cs.verse_a, vo.verse_a) AS verse_a, coalesce(cs.verse_b, vo.verse_b) AS verse_b, CASE WHEN coalesce(hits, 0) > 0 AND coalesce(votes, 0) > 0 THEN 'quotation' WHEN coalesce(hits, 0) > 0 THEN 'echo'
      WHEN coalesce(shared, 0) > 0 AND coalesce(votes, 0) > 0 THEN 'allusion' WHEN coalesce(shared, 0) > 0 THEN 'kin' ELSE 'listed' END AS kind FROM cs FULL JOIN vo ON cs.verse_a = vo.verse_a AND cs.verse_b = vo.verse_b""",
    "rival_check": f"""{_CS}, k AS (SELECT kn.verse_a, kn.verse_b, score, coalesce(votes, 0) > 0 AS listed FROM kn LEFT JOIN vo USING (verse_a, verse_b)), b AS (SELECT * FROM k UNION ALL SELECT verse_b, verse_a, score, listed FROM k),
      r AS (SELECT *, bool_or(listed) OVER (PARTITION BY verse_a) AS any_, row_number() OVER (PARTITION BY verse_a ORDER BY score DESC, verse_b) AS n FROM b) SELECT verse_a, verse_b, CASE WHEN listed THEN 'listed' WHEN any_ THEN 'rival' ELSE 'unlisted' END AS standing FROM r WHERE n = 1""",
    "number_words": f"{_T} SELECT book, count(*) AS words, count(*) FILTER (lower(surface) IN {sql_list(NUMBERS)}) AS numbers, round(1000 * count(*) FILTER (lower(surface) IN {sql_list(NUMBERS)}) / count(*)::DOUBLE, 2) AS per_thousand FROM tk GROUP BY 1",
    "station_words": f"""{_WB.replace(_T, _PV, 1)} SELECT passage_id, count(*) AS words, count(DISTINCT (ct.book, ct.root)) AS roots FROM pv JOIN ct USING (verse_id) JOIN wk ON wk.book = ct.book AND wk.root = ct.root WHERE keyness >= 10.83 GROUP BY 1""",
    "citation_counts": "SELECT from_book, count(*) AS links, count(*) FILTER (relevance_score < 0) AS declined, max(relevance_score) AS best FROM (SELECT DISTINCT id, trim(lower(from_book)) AS from_book, relevance_score FROM cross_references) GROUP BY 1",
    "parsing_counts": f"{_T} SELECT root, morph, count(*) AS uses FROM ct WHERE morph IS NOT NULL GROUP BY 1, 2",
    "book_codes": f"""{_T}, v AS (SELECT book, count(DISTINCT chapter) AS chapters, count(*) AS verses FROM vb GROUP BY 1) SELECT b.book, code, coalesce(chapters, 0) AS chapters, coalesce(verses, 0) AS verses FROM (SELECT name AS book, min(abbreviation) AS code FROM books WHERE name IS NOT NULL GROUP BY 1) b LEFT JOIN v USING (book)""",
    "part_words": f"""WITH p AS (SELECT p_brand, word, count(*) AS n FROM (SELECT p_brand, unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE word <> '' GROUP BY 1, 2), x AS (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS size, sum(n) OVER (PARTITION BY word) AS total, sum(n) OVER () AS ev FROM p)
      SELECT p_brand, word, n, round({M.sql_g2('n', 'total - n', 'size', 'ev - size')}, 6) + 0.0 AS keyness FROM x""",
    "market_baskets": """WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT x.p_brand AS brand_a, y.p_brand AS brand_b, count(*) AS orders FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY 1, 2""",
    "region_revenue": """SELECT r_name, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS worth FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
}
