"""Pages: an action as named DataFrames, lazy until they are shown or stored; with a build they read stored facts alone."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from quillmark.operators import links as L
from quillmark.plans.notation import Action, parse
from quillmark.plans.store import Facts
from quillmark.sources.tables import table

Page = dict[str, DataFrame]


def collected(page: Page, jobs: int = 8) -> dict[str, list[Row]]:
    """The rows of a page's tables, ``jobs`` tables at a time; a page's tables are meant to be read."""
    with ThreadPoolExecutor(jobs) as pool:
        return dict(zip(page, pool.map(lambda df: df.collect(), page.values())))


def verses_with_root(spark: SparkSession, d: str, root: str, scope: str | None = None, build: str | None = None) -> DataFrame:
    t = Facts(spark, d, build)("root_verses").where(F.col("root") == root)
    return (t.where(F.col("book") == scope) if scope else t).select("book", "chapter", "verse", "verse_id")


def verses_with_phrase(spark: SparkSession, d: str, phrase: str, scope: str | None = None, build: str | None = None, outside: bool = False) -> DataFrame:
    """Verses with a phrase, in the scope or, with ``outside``, in all other books."""
    v = Facts(spark, d, build)("verses").where(F.contains("word_string", F.lit(f" {phrase.lower()} ")) | F.contains("phrase_string", F.lit(f" {phrase} ")))
    if scope:
        v = v.where((F.col("book") != scope) if outside else (F.col("book") == scope))
    return v.select("book", "chapter", "verse", "verse_id", "text")


def meetings(spark: SparkSession, d: str, a: str, b: str, window: int = 5, scope: str | None = None, build: str | None = None) -> DataFrame:
    """Verses where two roots stand within ``window`` words, with the number of meetings; both sides are filtered before they meet."""
    t = Facts(spark, d, build)("words").select("verse_id", "book", "position", "root")
    t = t.where(F.col("book") == scope) if scope else t
    x = t.where(F.col("root") == a).select("verse_id", "book", F.col("position").alias("p"))
    y = t.where(F.col("root") == b).select("verse_id", F.col("position").alias("q"))
    return x.join(y, "verse_id").where(F.abs(F.col("p") - F.col("q")).between(1, window)).groupBy("book", "verse_id").agg(F.count("*").alias("meetings"))


def word_page(spark: SparkSession, d: str, root: str, scope: str | None = None, build: str | None = None) -> Page:
    f = Facts(spark, d, build)
    one = lambda name, c="root": f(name).where(F.col(c) == root)
    pull = one("pull", "focus").where(F.col("scope") == (scope or "(all)"))
    held = f("formulas").where(F.contains(F.concat(F.lit(" "), "phrase", F.lit(" ")), F.lit(f" {root} ")))
    return {
        "weights": one("weight_scales"), "forms": one("common_form"), "behind": one("lexicon_display"), "neighbours": pull.orderBy(F.desc("pull"), "neighbour").limit(25), "shadow": one("shadow", "focus"),
        "verses": verses_with_root(spark, d, root, scope, build), "renderings": one("renderings"), "home": one("word_book").orderBy(F.desc("keyness"), "book"), "formulas": held.orderBy(F.desc("verses"), "phrase").limit(25),
    }


def book_page(spark: SparkSession, d: str, book: str, build: str | None = None) -> Page:
    f = Facts(spark, d, build)
    of = lambda name: f(name).where(F.col("book") == book)
    top = of("signature_words").select(F.col("root"))
    return {
        "totals": of("book_totals"), "signature": of("signature_words"), "behind": f("lexicon_display").join(top, "root", "left_semi"), "kind": of("group_keyness").orderBy(F.desc("keyness"), "root").limit(25), "function_words": of("function_profile"),
        "richness": of("richness"), "partners": of("echo_partners").orderBy(F.desc("echoes"), "partner"), "echoes": of("echo_places").orderBy("verse_id", "phrase"), "formulas": of("folded_signatures").orderBy("rank"),
        "reach_depth": of("reach_depth"), "within": of("shared_vocabulary").orderBy(F.desc("weight"), "chapter_a", "chapter_b"), "grammar": of("parts_of_speech"), "verbs": of("verb_table"),
        "sections": of("section_words"), "nearest": of("nearest_books"), "spots": of("spots"), "lift": of("book_lift").orderBy(F.desc("lift"), "root").limit(40),
    }


def chapter_page(spark: SparkSession, d: str, book: str, chapter: int, build: str | None = None) -> Page:
    f = Facts(spark, d, build)
    here = lambda df: df.where((F.col("book") == book) & (F.col("chapter") == chapter))
    ids = here(f("verses")).select("verse_id")
    words = here(f("word_chapter")).orderBy(F.desc("keyness"), "root").limit(25)
    near = f("pull").where((F.col("scope") == book) & (F.col("pull") > 0)).join(words.select(F.col("root").alias("focus")), "focus", "left_semi")
    return {
        "words": words, "neighbours": near.orderBy("focus", F.desc("pull"), "neighbour"), "echoes": f("echo_places").where(F.col("book") == book).join(ids, "verse_id", "left_semi"),
        "synopsis": f("synopsis").join(ids.withColumnRenamed("verse_id", "verse_a"), "verse_a", "left_semi"), "kin": _kin(f, ids).limit(8), "strip": here(f("chapter_strip")), "verbs": here(f("verb_table")),
    }


def _kin(f: Facts, ids: DataFrame) -> DataFrame:
    k = f("kin_ordered")
    both = k.unionByName(k.select(F.col("verse_b").alias("verse_a"), F.col("verse_a").alias("verse_b"), "shared", "in_order", "score"))
    return both.join(ids.withColumnRenamed("verse_id", "verse_a"), "verse_a", "left_semi").orderBy(F.desc("score"), "verse_a", "verse_b")


def kin_page(spark: SparkSession, d: str, book: str, place: str, build: str | None = None) -> Page:
    f = Facts(spark, d, build)
    chapter, _, verses = place.partition(":")
    v = f("verses").where((F.col("book") == book) & (F.col("chapter") == int(chapter)))
    if verses:
        low, _, high = verses.partition("-")
        v = v.where(F.col("verse").between(int(low), int(high or low)))
    return {"kin": _kin(f, v.select("verse_id"))}


def compare_page(spark: SparkSession, d: str, a: str, b: str, build: str | None = None) -> Page:
    f = Facts(spark, d, build)
    low, high = sorted((a, b))
    pair = lambda name: f(name).where((F.col("book_a") == low) & (F.col("book_b") == high))
    either = f("parallel_runs").where(((F.col("book_a") == low) & (F.col("book_b") == high)) | ((F.col("book_a") == high) & (F.col("book_b") == low)))
    return {"chapters": pair("compare_chapters"), "parallels": either.orderBy(F.desc("hits"), "verse_a", "verse_b"), "delta": pair("delta"), "closeness": pair("dice_books")}


def testament_page(spark: SparkSession, d: str, name: str, build: str | None = None) -> Page:
    from quillmark.operators import corpus as C

    f = Facts(spark, d, build)
    books = C.books(spark, d).where(F.col("testament") == name).select("book")
    home = f("home_words").join(books.withColumnRenamed("book", "home"), "home", "left_semi")
    return {
        "books": f("book_totals").join(books, "book", "left_semi"), "home_words": home.orderBy(F.desc("share"), "root"), "home_map": home.groupBy("home").agg(F.count("*").alias("roots")).orderBy(F.desc("roots"), "home"),
        "leaning": f("leaning_words").where(F.col("leans") == name),
    }


def passage_page(spark: SparkSession, d: str, name: str, build: str | None = None) -> Page:
    f = Facts(spark, d, build)
    ids = table(spark, d, "passages").where(F.col("name") == name).select("passage_id").distinct()
    of = lambda df: f(df).join(ids, "passage_id", "left_semi")
    return {"verses": of("passage_verses"), "lift": of("passage_lift").orderBy(F.desc("keyness"), "root").limit(40), "absence": of("passage_absence")}


def theme_page(spark: SparkSession, d: str, name: str, build: str | None = None) -> Page:
    f = Facts(spark, d, build)
    of = lambda df: f(df).where(F.col("theme_id") == name)
    return {"roles": of("theme_roles"), "strip": of("theme_strip").orderBy("book", "chapter")}


def verse_page(spark: SparkSession, d: str, book: str, chapter: int, verse: int, build: str | None = None) -> Page:
    f = Facts(spark, d, build)
    at = lambda df: df.where((F.col("book") == book) & (F.col("chapter") == chapter) & (F.col("verse") == verse))
    ids = at(f("verses")).select("verse_id")
    words = at(f("words"))
    votes = f("link_votes").join(ids.withColumnRenamed("verse_id", "from_verse"), "from_verse", "left_semi")
    company = f("pull").where((F.col("scope") == book) & (F.col("pull") > 0)).join(words.select(F.col("root").alias("focus")).distinct(), "focus", "left_semi")
    return {
        "text": at(f("verses")), "words": words.orderBy("position"), "links": votes.orderBy(F.desc("votes"), "to_verse"), "parallels": f("synopsis").join(ids.withColumnRenamed("verse_id", "verse_a"), "verse_a", "left_semi"),
        "company": company.orderBy(F.desc("pull"), "focus", "neighbour").limit(25), "echoes": f("echo_places").join(ids, "verse_id", "left_semi"), "kin": _kin(f, ids).limit(8),
    }


def section_page(spark: SparkSession, d: str, name: str, build: str | None = None) -> Page:
    book, _, section = name.rpartition(" ")
    f = Facts(spark, d, build)
    here = (F.col("book") == book) & (F.col("section") == int(section))
    chapters = F.floor((F.col("chapter") - 1) / 10) == int(section)
    return {"words": f("section_words").where(here), "strip": f("chapter_strip").where((F.col("book") == book) & chapters), "verbs": f("verb_table").where((F.col("book") == book) & chapters)}


def answer(spark: SparkSession, d: str, question: str | Action, build: str | None = None) -> Page:
    """The page of a line of notation; book names may be written in any case or as abbreviations."""
    a = parse(question) if isinstance(question, str) else question
    named = lambda x: (L.book_names(table(spark, d, "books")).where(F.col("key") == x.strip().lower().removesuffix(".")).select("book").first() or [x])[0]
    scope = named(a.scope) if a.scope else None
    if a.kind == "word":
        return word_page(spark, d, a.args[0], scope, build)
    if a.kind == "pair":
        return {"meetings": meetings(spark, d, *a.args, scope=scope, build=build)}
    if a.kind == "phrase":
        return {"verses": verses_with_phrase(spark, d, a.args[0], scope, build)} | ({"outside": verses_with_phrase(spark, d, a.args[0], scope, build, True)} if scope else {})
    if a.kind == "book":
        return book_page(spark, d, named(a.args[0]), build)
    if a.kind == "chapter":
        return chapter_page(spark, d, named(a.args[0]), int(a.args[1]), build)
    if a.kind == "verse":
        return verse_page(spark, d, named(a.args[0]), int(a.args[1]), int(a.args[2]), build)
    if a.kind == "kin":
        return kin_page(spark, d, named(a.args[0]), a.args[1], build)
    if a.kind == "compare":
        return compare_page(spark, d, named(a.args[0]), named(a.args[1]), build)
    pages = {"testament": testament_page, "passage": passage_page, "theme": theme_page, "section": section_page}
    return pages[a.kind](spark, d, a.args[0], build)


def dossier(spark: SparkSession, d: str, book: str, build: str | None = None) -> dict[str, Page]:
    """Every page of a book: its own, its comparisons with the five nearest books, and its chapters. It has a page for each chapter, so it is best read from a build."""
    f = Facts(spark, d, build)
    near = [r["near"] for r in f("nearest_books").where(F.col("book") == book).orderBy("rank").collect()]
    chapters = [r["chapter"] for r in f("verses").where(F.col("book") == book).select("chapter").distinct().orderBy("chapter").collect()]
    return {book: book_page(spark, d, book, build)} | {f"{book} ~ {b}": compare_page(spark, d, book, b, build) for b in near} | {f"{book} {c}": chapter_page(spark, d, book, c, build) for c in chapters}
