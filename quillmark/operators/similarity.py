"""Likeness of verses, chapters and books: rare words, shared runs, longest common subsequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillmark.functions import measures as M
from quillmark.functions.lists import RARE
from quillmark.functions.sequences import lcs
from quillmark.operators.facts import is_stop
from quillmark.session import cut_lineage


def rarities(tokens: DataFrame, books: DataFrame) -> DataFrame:
    """(root, weight, total, rarity): how rare a content root is among all words of its text; a tagged root's text is its testament, OT for H and NT for G."""
    w = tokens.where("root is not null and not is_stop").groupBy("root").agg(F.count("*").alias("weight"))
    n = tokens.groupBy("book").agg(F.count("*").alias("n")).join(books.select("book", "testament"), "book", "left")
    part = lambda t: n.agg(F.sum(F.when(F.col("testament") == t, F.col("n")))).scalar()
    w = w.withColumns({"ot": part("OT"), "nt": part("NT"), "every": n.agg(F.sum("n")).scalar()})
    w = w.withColumn("total", F.when(F.col("root").rlike(r"^H\d+$"), F.col("ot")).when(F.col("root").rlike(r"^G\d+$"), F.col("nt")).otherwise(F.col("every")))
    return w.select("root", "weight", "total", M.rarity("weight", "total").alias("rarity"))


def rare_roots(tokens: DataFrame, books: DataFrame, limit: int = RARE) -> DataFrame:
    """(root, rarity) of the content roots that are at most one in ``limit`` words."""
    return rarities(tokens, books).where(F.col("weight") * limit <= F.col("total")).select("root", "rarity")


#: Records expected to share a combination of roots from which a longer one is taken.
CROWD = 32.0


def _rarest_keys(o: Column, n: Column, verses: float, close: bool) -> Column:
    """Hashes of combinations of up to three of the roots ``o`` (array of (df, unit), rare ones first), longer where the rarest is common.

    Two records that share three units share the combination of their three rarest, and both see how common the first is. ``close`` says that
    every unit counts in both records, so that the first lies among all but the last two.
    """
    last = n - 2 if close else n

    def keys(x: Column, i: Column) -> Column:
        df = x["df"].cast("double")
        rest = F.slice(o, i + 2, n)
        pairs = F.transform(rest, lambda y: F.xxhash64(F.lit(2), x["t"], y["t"]))
        triples = F.flatten(F.transform(rest, lambda y, j: F.transform(F.slice(o, i + j + 3, n), lambda z: F.xxhash64(F.lit(3), x["t"], y["t"], z["t"]))))
        return F.when(df <= CROWD, F.array(F.xxhash64(F.lit(1), x["t"]))).when(df * df * 4 / verses <= CROWD, pairs).otherwise(triples)

    return F.flatten(F.transform(F.slice(o, 1, F.greatest(last, F.lit(0))), keys))


def kin(tokens: DataFrame, books: DataFrame, least: int = 3, limit: int = RARE) -> DataFrame:
    """(verse_a, verse_b, shared, score): verses that share at least ``least`` = 3 rare roots.

    Candidates meet in combinations of their rarest shared roots, longer ones where the rarest is common, so a root that a growing text uses
    ever more often is never the key by itself, and a root of few verses is one key, not all the triples it stands in.
    """
    if least != 3:
        raise ValueError("the join is made on up to three roots")
    rare = rare_roots(tokens, books, limit)
    words = cut_lineage(tokens.where("root is not null and not is_stop").groupBy("verse_id", "root").agg(F.min("position").alias("at")).join(rare, "root"))
    every = float(max(1, words.select(F.count_distinct("verse_id")).first()[0]))
    words = words.join(words.groupBy("root").agg(F.count("*").alias("df")), "root")
    verses = words.groupBy("verse_id").agg(F.sort_array(F.collect_list(F.struct("root", "rarity", "at"))).alias("r"), F.sort_array(F.collect_list(F.struct("df", F.col("root").alias("t")))).alias("o")).where(F.size("r") >= 3)
    keys = verses.select("verse_id", F.explode(_rarest_keys(F.col("o"), F.size("o"), every, True)).alias("key"))
    verses = verses.drop("o")
    a, b = keys.withColumnRenamed("verse_id", "verse_a"), keys.withColumnRenamed("verse_id", "verse_b")
    met = a.join(b, "key").where("verse_a < verse_b").select("verse_a", "verse_b").distinct()
    out = met.join(verses.select(F.col("verse_id").alias("verse_a"), F.col("r").alias("ra")), "verse_a").join(verses.select(F.col("verse_id").alias("verse_b"), F.col("r").alias("rb")), "verse_b")
    names = lambda c: F.transform(c, lambda x: x["root"])
    both = F.filter("ra", lambda x: F.array_contains(names(F.col("rb")), x["root"]))
    out = out.withColumn("both", both).where(F.size("both") >= least)
    score = F.aggregate("both", F.lit(0.0), lambda s, x: s + x["rarity"])
    in_order = lambda c: F.transform(F.array_sort(F.transform(F.filter(c, lambda x: F.array_contains(names(F.col("both")), x["root"])), lambda x: F.struct(x["at"], x["root"]))), lambda x: x["root"])
    return out.select("verse_a", "verse_b", F.size("both").alias("shared"), score.alias("score"), in_order(F.col("ra")).alias("order_a"), in_order(F.col("rb")).alias("order_b"))


def kin_ordered(pairs: DataFrame) -> DataFrame:
    """Kin with the score raised by up to half where the shared words keep their order."""
    out = pairs.withColumn("in_order", lcs("order_a", "order_b"))
    return out.select("verse_a", "verse_b", "shared", "in_order", (F.col("score") * (1 + 0.5 * F.col("in_order") / F.col("shared"))).alias("score"))


def shared_vocabulary(content: DataFrame, low: int = 2, high: int = 5) -> DataFrame:
    """(book, chapter_a, chapter_b, shared, weight): chapters of one book sharing roots that few of its chapters have."""
    c = content.select("book", "chapter", "root").distinct()
    size = c.groupBy("book").agg(F.count_distinct("chapter").alias("n"))
    sets = c.groupBy("book", "root").agg(F.count("*").alias("df"), F.slice(F.sort_array(F.collect_list("chapter")), 1, high).alias("at")).where(F.col("df").between(low, high))
    first = sets.select("book", "df", "at", F.posexplode("at").alias("i", "chapter_a"))
    pairs = first.select("book", "df", "chapter_a", F.explode(F.slice("at", F.col("i") + 2, F.size("at"))).alias("chapter_b")).join(size, "book")
    return pairs.groupBy("book", "chapter_a", "chapter_b").agg(F.count("*").alias("shared"), F.sum(F.log(F.col("n") / F.col("df"))).alias("weight"))


def runs_of(units: DataFrame, n: int, content_words: int = 2, of: str = "units") -> DataFrame:
    """(verse_id, book, chapter, at, run): runs of ``n`` units, or of ``n`` words as written, with enough content words."""
    rows = units if of == "words" else units.where("size(units) = size(words)")
    rows = rows.withColumn("z", F.arrays_zip(F.col(of).alias("u"), F.col("words").alias("w"))).where(F.size("z") >= n)
    at = F.transform(F.sequence(F.lit(1), F.size("z") - n + 1), lambda i: F.struct(i.alias("at"), F.slice("z", i, n).alias("z")))
    out = rows.select("verse_id", "book", "chapter", F.explode(at).alias("r"))
    out = out.where(F.size(F.filter("r.z", lambda x: ~is_stop(x["w"]))) >= content_words)
    return out.select("verse_id", "book", "chapter", F.col("r.at").alias("at"), F.array_join("r.z.u", " ").alias("run"))


def run_classes(runs: DataFrame) -> DataFrame:
    """(run, verse_id, book, verses, books): each run that more than one verse holds, with its verses; a run held by any number of them is so many rows."""
    distinct = runs.select("run", "verse_id", "book").distinct()
    held = distinct.groupBy("run").agg(F.count("*").alias("verses"), F.count_distinct("book").alias("books")).where("verses > 1")
    return distinct.join(held, "run")


def run_pairs(runs: DataFrame, most: int | None = None) -> DataFrame:
    """(verse_a, book_a, verse_b, book_b, hits): verses sharing runs, with the number of runs; no run is left out for the number of its verses.

    With ``most`` only runs in at most so many verses are made into pairs; ``run_classes`` then gives the others. Runs are joined by a digest,
    so that adaptive execution can split a hot one.
    """
    c = run_classes(runs)
    c = (c if most is None else c.where(F.col("verses") <= most)).select(F.xxhash64("run").alias("r1"), F.hash("run").alias("r2"), "verse_id", "book")
    a, b = (c.select("r1", "r2", F.col("verse_id").alias(f"verse_{x}"), F.col("book").alias(f"book_{x}")) for x in "ab")
    return a.join(b, ["r1", "r2"]).where("verse_a < verse_b").groupBy("verse_a", "book_a", "verse_b", "book_b").agg(F.count("*").alias("hits"))


def verse_roots(content: DataFrame) -> DataFrame:
    """(verse_id, units): the content roots of each verse in their order."""
    return content.groupBy("verse_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "root"))), lambda x: x["root"]).alias("units"))


def render_run(here: list[str], there: list[str]) -> str:
    """A shared run as text, with what differs between its ends as [here / there]."""
    k = 0
    while k < min(len(here), len(there)) and here[k] == there[k]:
        k += 1
    j = 0
    while j < min(len(here), len(there)) - k and here[-1 - j] == there[-1 - j]:
        j += 1
    gap = [] if len(here) == len(there) == k + j else [f"[{' '.join(here[k : len(here) - j]) or '-'} / {' '.join(there[k : len(there) - j]) or '-'}]"]
    return " ".join([*here[:k], *gap, *here[len(here) - j :]])


def maximal_runs(near: DataFrame, far: DataFrame, n: int, most: int) -> DataFrame:
    """(near_verse, far_verse, near_at, far_at, length): longest runs that a near and a far verse share.

    Runs of ``n`` units are joined, of the far ones those in at most ``most`` places; matches on one diagonal that follow each other are one run.
    """
    rare = far.select("run", "verse_id").distinct().groupBy("run").agg(F.count("*").alias("c")).where(F.col("c") <= most).select("run")
    f = far.join(rare, "run", "left_semi").select("run", F.col("verse_id").alias("far_verse"), F.col("at").alias("far_at"))
    m = near.select("run", F.col("verse_id").alias("near_verse"), F.col("at").alias("near_at")).join(f, "run").drop("run").distinct()
    w = Window.partitionBy("near_verse", "far_verse", F.col("near_at") - F.col("far_at")).orderBy("near_at")
    m = m.withColumn("diagonal", F.col("near_at") - F.col("far_at")).withColumn("island", F.col("near_at") - F.row_number().over(w))
    out = m.groupBy("near_verse", "far_verse", "diagonal", "island").agg(F.min("near_at").alias("near_at"), F.min("far_at").alias("far_at"), F.count("*").alias("k"))
    return out.select("near_verse", "far_verse", "near_at", "far_at", (F.col("k") + n - 1).alias("length"))
