"""Fact tables of a corpus: weights, keyness, depth, neighbours, formulas and echoes.

Counts are made once at the finest scale and rolled up, so that coarser scales never read the text again. Formulas grow with the
text; every filter on them is a threshold of the measure, none a cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillmark.functions import measures as M
from quillmark.functions.lists import ECHO_MOST, FORMULA_LENGTHS, STOPLIST, VOICE_TAGS, WINDOW
from quillmark.operators.corpus import ROOT

ALL = "(all)"


def chapter_counts(content: DataFrame) -> DataFrame:
    """(book, chapter, root, weight, verses): every coarser count follows from it, as a verse lies in one chapter."""
    by_verse = content.groupBy("book", "chapter", "verse_id", "root").agg(F.count("*").alias("weight"))
    return by_verse.groupBy("book", "chapter", "root").agg(F.sum("weight").alias("weight"), F.count("*").alias("verses"))


def book_counts(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("book", "root").agg(F.sum("weight").alias("weight"), F.sum("verses").alias("verses"), F.count("*").alias("chapters"))


def word_counts(books: DataFrame) -> DataFrame:
    return books.groupBy("root").agg(F.sum("weight").alias("weight"), F.sum("verses").alias("verses"), F.sum("chapters").alias("chapters"), F.count("*").alias("books"))


def weight_scales(chapters: DataFrame) -> DataFrame:
    """Weight and reach of every root at the three scales, in one long table; ``(all)`` and chapter -1 stand for a whole."""
    b = book_counts(chapters)
    w = word_counts(b)
    cols = ["scope", "chapter", "root", "weight", "verses", "chapters", "books"]
    one = F.lit(1).cast("long")
    parts = [
        chapters.select(F.col("book").alias("scope"), "chapter", "root", "weight", "verses", one.alias("chapters"), one.alias("books")),
        b.select(F.col("book").alias("scope"), F.lit(-1).alias("chapter"), "root", "weight", "verses", "chapters", one.alias("books")),
        w.select(F.lit(ALL).alias("scope"), F.lit(-1).alias("chapter"), *cols[2:]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def chapter_sizes(tokens: DataFrame) -> DataFrame:
    """(book, chapter, words): all word occurrences, function words too; what rates and keyness are measured by."""
    return tokens.groupBy("book", "chapter").agg(F.count("*").alias("words"))


def comparison_totals(counts: DataFrame, books: DataFrame, sizes: DataFrame) -> DataFrame:
    """``counts`` (book, root, weight, ...) with the totals each root is held against, by the language rule.

    A tagged root is compared with its book's testament, a stem with the whole text. Adds ``root_total`` (all uses of the root) and
    ``layer_total`` (words of the comparison text). Books that the book list doesn't name make a layer of their own. The totals are
    sums over counts; by book they are few rows.
    """
    named = books.select("book", "testament")
    layers = sizes.join(named, "book", "left").groupBy(F.coalesce("testament", F.lit("")).alias("layer")).agg(F.sum("words").alias("layer_total"))
    layers = layers.unionByName(sizes.agg(F.lit(ALL).alias("layer"), F.sum("words").alias("layer_total")))
    c = counts.join(named, "book", "left")
    c = c.withColumn("layer", F.when(F.col("root").rlike(ROOT), F.coalesce("testament", F.lit(""))).otherwise(F.lit(ALL)))
    roots = counts.groupBy("root").agg(F.sum("weight").alias("root_total"))
    return c.join(roots, "root").join(layers, "layer").drop("testament", "layer")


def book_keyness(chapters: DataFrame, books: DataFrame, sizes: DataFrame) -> DataFrame:
    """Keyness of every root in its book against the rest of its layer: (book, root, weight, verses, chapters, book_total, keyness)."""
    b = comparison_totals(book_counts(chapters), books, sizes).join(sizes.groupBy("book").agg(F.sum("words").alias("book_total")), "book")
    key = M.g2("weight", F.col("root_total") - F.col("weight"), "book_total", F.col("layer_total") - F.col("book_total"))
    return b.select("book", "root", "weight", "verses", "chapters", "book_total", key.alias("keyness"))


def chapter_keyness(chapters: DataFrame, books: DataFrame, sizes: DataFrame) -> DataFrame:
    c = comparison_totals(chapters, books, sizes).join(sizes, ["book", "chapter"])
    key = M.g2("weight", F.col("root_total") - F.col("weight"), "words", F.col("layer_total") - F.col("words"))
    return c.select("book", "chapter", "root", "weight", "verses", key.alias("keyness"))


def depth(keyness: DataFrame, by: list[str]) -> DataFrame:
    """The highest positive keyness of a root in one chapter, to six decimals, with the chapter; the earliest of equals."""
    best = F.struct(F.col("keyness").alias("k"), (-F.col("chapter")).alias("c"))
    out = keyness.withColumn("keyness", M.rounded(F.col("keyness"))).where("keyness > 0").groupBy(*by).agg(F.max(best).alias("b"))
    return out.select(*by, F.col("b.k").alias("depth"), (-F.col("b.c")).alias("depth_chapter"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order; Spark keeps only ``k`` rows of a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def commonest(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The commonest value of each group with its count and share; of equals the first by code point."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    out = n.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("b"), F.sum("n").alias("total"), F.count("*").alias("forms"))
    return out.select(*by, F.col("b.v").alias(value), (-F.col("b.n")).alias("uses"), "total", "forms")


def neighbours(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """(book, focus, neighbour, n): content words within ``window`` words of each other in a verse, both ways, roots unlike.

    Each word looks only forward, at the next ``window`` words, so a verse is sorted once and no join is needed; the other direction is
    the same pair turned round.
    """
    w = Window.partitionBy("verse_id").orderBy("position")
    t = tokens.select("book", "verse_id", "position", F.when(F.col("root").isNotNull() & ~F.col("is_stop"), F.col("root")).alias("root"))
    ahead = F.array_compact(F.array(*(F.lead("root", k).over(w) for k in range(1, window + 1))))
    pairs = t.withColumn("ahead", ahead).where("root is not null").select("book", "root", F.explode("ahead").alias("other")).where("root <> other")
    counted = pairs.groupBy("book", "root", "other").agg(F.count("*").alias("n"))
    both = counted.select("book", F.explode(F.array(F.struct(F.col("root").alias("focus"), F.col("other").alias("neighbour")), F.struct(F.col("other").alias("focus"), F.col("root").alias("neighbour")))).alias("p"), "n")
    return both.groupBy("book", "p.focus", "p.neighbour").agg(F.sum("n").alias("n"))


def focus_windows(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """(book, focus, occurrences, inside): how often a root is a focus and how many words its windows hold."""
    w = Window.partitionBy("verse_id")
    t = tokens.withColumn("i", F.row_number().over(w.orderBy("position")) - 1).withColumn("m", F.count("*").over(w))
    inside = F.least(F.col("i"), F.lit(window)) + F.least(F.col("m") - 1 - F.col("i"), F.lit(window))
    return t.where("root is not null and not is_stop").groupBy("book", F.col("root").alias("focus")).agg(F.count("*").alias("occurrences"), F.sum(inside).alias("inside"))


def with_total(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Rows by book, and their sums over all books under the scope ``(all)``."""
    whole = df.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums)).select(F.lit(ALL).alias("scope"), *keys, *sums)
    return df.select(F.col("book").alias("scope"), *keys, *sums).unionByName(whole)


def pull(neighbours_: DataFrame, windows: DataFrame, sizes: DataFrame, least: int = 1, least_all: int = 2) -> DataFrame:
    """(scope, focus, neighbour, n, pull): log-likelihood of a neighbour inside the windows against outside, by book and for all."""
    n = with_total(neighbours_, ["focus", "neighbour"], ["n"]).where(F.col("n") >= F.when(F.col("scope") == ALL, least_all).otherwise(least))
    f = with_total(windows, ["focus"], ["occurrences", "inside"])
    weights = f.select("scope", F.col("focus").alias("neighbour"), F.col("occurrences").alias("weight"))
    totals = with_total(sizes.groupBy("book").agg(F.sum("words").alias("total")), [], ["total"])
    out = n.join(f, ["scope", "focus"]).join(weights, ["scope", "neighbour"]).join(totals, "scope")
    return out.select("scope", "focus", "neighbour", "n", M.g2("n", F.col("weight") - F.col("n"), "inside", F.col("total") - F.col("inside")).alias("pull"))


def shadow(pairs: DataFrame) -> DataFrame:
    """Sum of the positive pull of a word's neighbours in a scope."""
    return pairs.groupBy("scope", "focus").agg(F.sum(F.greatest("pull", F.lit(0.0))).alias("shadow"))


def is_stop(c: Column) -> Column:
    return c.isin(*sorted(STOPLIST))


def formulas(units: DataFrame, lengths: tuple[int, ...] = FORMULA_LENGTHS) -> DataFrame:
    """(verse_id, book, language, n, phrase, wording): each run of units in a verse that doesn't end on a function word."""
    both = F.arrays_zip(F.col("units").alias("u"), F.col("words").alias("w"))
    rows = units.where("size(units) = size(words) and size(units) > 0").withColumn("z", both)
    starts = F.sequence(F.lit(1), F.size("units"))
    runs = F.flatten(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.transform(F.filter(starts, lambda i: i + n - 1 <= F.size("units")), lambda i: F.struct(n.alias("n"), F.slice("z", i, n).alias("z")))))
    out = rows.select("verse_id", "book", "chapter", "language", F.explode(runs).alias("r")).where(~is_stop(F.element_at("r.z.w", -1)))
    return out.select("verse_id", "book", "chapter", "language", F.col("r.n").alias("n"), F.array_join("r.z.u", " ").alias("phrase"), F.array_join("r.z.w", " ").alias("wording"))


def formula_facts(runs: DataFrame, least: int = 2) -> DataFrame:
    """(phrase, n, verses, times, books, display) of formulas in at least ``least`` verses; display is the commonest wording.

    Formulas are counted by 128 bits of digest; their texts are fetched only for those in enough verses, and go out once at most.
    """
    marks = {"h1": F.xxhash64("phrase"), "h2": F.xxhash64(F.lit(1), "phrase")}
    k = runs.select(*(c.alias(n) for n, c in marks.items()), "n", "book", "verse_id")
    facts = k.groupBy("h1", "h2", "n", "book", "verse_id").agg(F.count("*").alias("t")).groupBy("h1", "h2", "n", "book").agg(F.count("*").alias("v"), F.sum("t").alias("t"))
    facts = facts.groupBy("h1", "h2", "n").agg(F.sum("v").alias("verses"), F.sum("t").alias("times"), F.count("*").alias("books")).where(F.col("verses") >= least)
    own = ["h1", "h2", "phrase", "n", "verses", "times", "books"]
    held = runs.select("phrase", "wording").withColumns(marks).join(facts, ["h1", "h2"])
    by_wording = held.groupBy(*own, "wording").agg(F.count("*").alias("t"))
    out = by_wording.groupBy(*own).agg(F.min(F.struct((-F.col("t")).alias("t"), "wording")).alias("b"))
    return out.select(*own[2:], F.col("b.wording").alias("display"))


def substance(phrase: Column) -> Column:
    """At least two content words remain when the voice tags are taken out."""
    rest = F.lower(phrase)
    for tag in VOICE_TAGS:
        rest = F.replace(rest, F.lit(tag), F.lit(" "))
    return F.size(F.filter(F.split(rest, " "), lambda w: (w != "") & ~is_stop(w))) >= 2


def echoes(facts: DataFrame, most: int = ECHO_MOST) -> DataFrame:
    """Rare formulas of three words or more that two books or more share."""
    return facts.where((F.col("n") >= 3) & F.col("verses").between(2, most) & (F.col("books") >= 2) & substance(F.col("display")))


def echoes_across(runs: DataFrame, most: int = ECHO_MOST) -> DataFrame:
    """(wording, n, verses, books, languages): wordings shared across languages, where the units never match."""
    r = runs.where("n >= 3 and language is not null").groupBy("wording", "n", "book", "language", "verse_id").agg(F.lit(1).alias("x"))
    out = r.groupBy("wording", "n").agg(F.count_distinct("verse_id").alias("verses"), F.count_distinct("book").alias("books"), F.count_distinct("language").alias("languages"))
    return out.where(F.col("verses").between(2, most) & (F.col("books") >= 2) & (F.col("languages") >= 2) & substance(F.col("wording")))


def places(runs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(phrase, n, verse_id, book): where chosen formulas stand, a verse once."""
    return runs.join(chosen.select("phrase"), "phrase", "left_semi").select("phrase", "n", "verse_id", "book", "chapter").distinct()


def partners(at: DataFrame) -> DataFrame:
    """(book_a, book_b, echoes): number of distinct echoes two books share, each pair once."""
    b = at.select("phrase", "book").distinct()
    sets = b.groupBy("phrase").agg(F.sort_array(F.collect_list("book")).alias("books"))  # an echo stands in few verses, so in few books
    first = sets.select("books", F.posexplode("books").alias("i", "book_a"))
    return first.select("book_a", F.explode(F.slice("books", F.col("i") + 2, F.size("books"))).alias("book_b")).groupBy("book_a", "book_b").agg(F.count("*").alias("echoes"))


def _common_start(a: Column, b: Column) -> Column:
    """The items with which two arrays begin alike."""
    n = F.least(F.size(a), F.size(b))
    unlike = F.filter(F.sequence(F.lit(1), n + 1), lambda i: (i > n) | (F.get(a, i - 1) != F.get(b, i - 1)))
    return F.slice(a, 1, F.array_min(unlike) - 1)


def grown(units: DataFrame, lengths: tuple[int, ...] = FORMULA_LENGTHS, least: int = 2) -> DataFrame:
    """(book, phrase, n, verses, grown): formulas in ``least`` verses of a book, grown to both sides as long as all these verses go on alike.

    What follows a formula is taken at its first place in each verse. All verses of a group go on alike exactly as far as the least and
    the greatest of what follows do, so growth is two partial aggregates for each side and no group of verses is gathered.
    """
    rows = units.where("size(units) = size(words) and size(units) > 0").select("verse_id", "book", "units", "words")
    starts = F.sequence(F.lit(1), F.size("units"))
    runs = F.flatten(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.transform(F.filter(starts, lambda i: i + n - 1 <= F.size("units")), lambda i: F.struct(i.alias("i"), n.alias("n")))))
    at = rows.select("book", "verse_id", "units", "words", F.explode(runs).alias("r")).where(~is_stop(F.element_at("words", F.col("r.i") + F.col("r.n") - 1)))
    u, i, n = F.col("units"), F.col("r.i"), F.col("r.n")
    place = F.struct(i.alias("i"), F.slice(u, i + n, F.size(u)).alias("after"), F.reverse(F.slice(u, 1, i - 1)).alias("before"))
    first = at.groupBy("book", "verse_id", F.array_join(F.slice(u, i, n), " ").alias("phrase"), n.alias("n")).agg(F.min(place).alias("p"))
    g = first.groupBy("book", "phrase", "n").agg(F.count("*").alias("verses"), *(f(f"p.{c}").alias(f"{k}_{c}") for c in ("after", "before") for k, f in (("a", F.min), ("z", F.max)))).where(F.col("verses") >= least)
    left, right = F.reverse(_common_start(F.col("a_before"), F.col("z_before"))), _common_start(F.col("a_after"), F.col("z_after"))
    return g.select("book", "phrase", "n", "verses", F.array_join(F.concat(left, F.array("phrase"), right), " ").alias("grown"))


def signature_formulas(units: DataFrame, sizes: DataFrame, tried: int = 75, shown: int = 25, cover: float = 0.8) -> DataFrame:
    """(book, rank, grown, verses, rest, keyness): the formulas that mark each book, judged on verses.

    The formulas of a book are grown, those that grow into one are taken once, by their best; of the ``tried`` best those are left out
    whose verses a longer one that holds them covers to ``cover``; what is grown is counted again outside the book. ``sizes`` has (book,
    size) in verses. Only the tried ones, a fixed number for each book, are set against each other.
    """
    g = grown(units)
    total = formulas(units).groupBy("phrase", "verse_id").agg(F.lit(1)).groupBy("phrase").agg(F.count("*").alias("total"))
    every = sizes.agg(F.sum("size")).scalar()
    key = lambda rest: M.g2("verses", rest, "size", F.col("every") - F.col("size"))
    s = g.join(total, "phrase").join(sizes, "book").withColumn("every", every).withColumn("rest", F.col("total") - F.col("verses"))
    s = s.withColumn("key0", M.rounded(key(F.col("rest"))))
    best = [F.desc("key0"), F.desc("n"), F.col("phrase")]
    chosen = top_k(top_k(s, ["book", "grown"], best, 1, "once"), ["book"], best, tried, "place").drop("once", "place")
    inside = chosen.select("book", F.col("grown").alias("g"), F.col("phrase").alias("q"), F.col("verses").alias("v"))
    pairs = chosen.select("book", "grown", "phrase", "verses").join(inside, "book").where((F.col("grown") != F.col("g")) & F.contains(F.concat(F.lit(" "), "g", F.lit(" ")), F.concat(F.lit(" "), "grown", F.lit(" "))))
    held = formulas(units).select("book", "phrase", "verse_id").join(chosen.select("book", "phrase"), ["book", "phrase"], "left_semi").distinct()
    both = pairs.join(held, ["book", "phrase"]).join(held.select("book", F.col("phrase").alias("q"), "verse_id"), ["book", "q", "verse_id"]).groupBy("book", "grown", "g", "verses").agg(F.count("*").alias("both"))
    nested = both.where(F.col("both") >= cover * F.col("verses")).select("book", "grown").distinct()
    left = chosen.join(nested, ["book", "grown"], "left_anti")
    longer = left.where("grown <> phrase").select("book", "grown", "phrase")
    away = units.select(F.col("book").alias("b"), "verse_id", F.concat(F.lit(" "), F.array_join("units", " "), F.lit(" ")).alias("s"))
    seen = formulas(units).select("phrase", F.col("book").alias("b"), "verse_id").join(longer.select("phrase").distinct(), "phrase", "left_semi").distinct().join(away, ["b", "verse_id"])
    count = longer.join(seen, "phrase").where((F.col("b") != F.col("book")) & F.contains("s", F.concat(F.lit(" "), "grown", F.lit(" ")))).groupBy("book", "grown").agg(F.count("*").alias("again"))
    out = left.join(count, ["book", "grown"], "left").withColumn("rest", F.when(F.col("grown") == F.col("phrase"), F.col("rest")).otherwise(F.coalesce("again", F.lit(0))))
    out = out.withColumn("keyness", M.rounded(key(F.col("rest"))))
    return top_k(out, ["book"], [F.desc("keyness"), F.desc(F.length("grown")), F.col("grown")], shown).select("book", "rank", "grown", "verses", "rest", "keyness")
