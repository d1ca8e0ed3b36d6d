"""Sets of words that travel together: level-wise search, floors, closedness, kinds and edges of books; ``grown`` searches them root by root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillmark.functions import measures as M
from quillmark.functions.lists import MIN_KEYNESS, MIN_LIFT
from quillmark.functions.sequences import tightest_span
from quillmark.session import cut_lineage


def vocabulary(units: DataFrame, least: int = 40, top: int | None = 600, leave_out: list[str] = ()) -> DataFrame:
    """(root, support): the roots in at least ``least`` units, the ``top`` of them where that is given; ``top`` bounds every level of the search."""
    s = units.groupBy("root").agg(F.count("*").alias("support")).where((F.col("support") >= least) & ~F.col("root").isin(*leave_out, ""))
    return s if top is None else s.orderBy(F.desc("support"), "root").limit(top)


def word_sets(units: DataFrame, vocab: DataFrame, least: int, largest: int = 4) -> DataFrame:
    """(members, size, support): all sets of 2 to ``largest`` roots of the vocabulary that stand together in ``least`` units.

    ``units`` has distinct (unit, root). Level by level: the frequent sets of a unit that agree but for the last root are joined inside
    the unit, so a set is made only where it occurs and all counts are exact. Each level is written once.
    """
    words = cut_lineage(units.join(vocab.select("root"), "root").select("unit", "root"))
    held = words.select("unit", F.array("root").alias("members"))
    levels = []
    for size in range(2, largest + 1):
        a = held.select("unit", F.slice("members", 1, size - 2).alias("head") if size > 2 else F.array().cast("array<string>").alias("head"), F.col("members"), F.element_at("members", -1).alias("last"))
        b = a.select("unit", "head", F.col("last").alias("next"))
        grown = a.join(b, ["unit", "head"]).where("last < next").select("unit", F.concat("members", F.array("next")).alias("members"))
        kept = cut_lineage(grown.groupBy("members").agg(F.count("*").alias("support")).where(F.col("support") >= least))
        levels.append(kept.withColumn("size", F.lit(size)))
        if size < largest:
            held = cut_lineage(grown.join(kept.select("members"), "members", "left_semi"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("members", "size", "support")


def measured(sets: DataFrame, vocab: DataFrame, n_units: Column) -> DataFrame:
    """Adds ``expected``, ``lift`` and ``g2`` of each set, were its roots spread over the units by chance."""
    x = sets.select("members", "size", "support", F.explode("members").alias("root")).join(vocab.select("root", F.col("support").alias("own")), "root")
    x = x.withColumn("n", n_units)
    out = x.groupBy("members", "size", "support", "n").agg(F.sum(F.log(F.col("own") / F.col("n"))).alias("l"))
    expected, lift, g2 = against_chance(F.col("l"))
    return out.select("members", "size", "support", expected.alias("expected"), lift.alias("lift"), g2.alias("g2"))


def against_chance(l: Column) -> tuple[Column, Column, Column]:
    """Expected support, lift and g2 of (support, n) where ``l`` is the sum of the logarithms of the members' shares of the units."""
    expected = F.exp(l) * F.col("n")
    return expected, F.col("support") / expected, M.g2_binomial("support", expected, "n")


def above_floors(sets: DataFrame) -> DataFrame:
    floor = F.element_at(F.create_map(*(F.lit(x) for kv in MIN_LIFT.items() for x in kv)), F.col("size"))
    return sets.where((F.col("lift") >= floor) & (F.col("g2") >= MIN_KEYNESS))


def closed(sets: DataFrame) -> DataFrame:
    """Adds ``closed``: no set of one root more has the same support. A set meets its supersets through their subsets, not each other."""
    n = F.size("members")
    less = sets.where("size > 2").select("support", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.filter("members", lambda x: x != F.element_at(F.col("members"), i)))).alias("members"))
    covered = less.distinct().withColumn("covered", F.lit(True))
    return sets.join(covered, ["members", "support"], "left").withColumn("closed", F.col("covered").isNull()).drop("covered")


def occurrences_of(sets: DataFrame, units: DataFrame) -> DataFrame:
    """(members, unit): the units that hold all roots of a set."""
    x = sets.select("members", "size", F.explode("members").alias("root")).join(units, "root")
    return x.groupBy("members", "size", "unit").agg(F.count("*").alias("k")).where("k = size").select("members", "unit")


def kinds(occ: DataFrame, verses: DataFrame, share: float = 0.5, span: int = 12) -> DataFrame:
    """(members, kind): phrase where most occurrences stand side by side, frame where they mostly stand within ``span`` words and number three or more, else constellation."""
    rows = occ.join(verses.select(F.col("verse_id").alias("unit"), "roots"), "unit").withColumn("width", tightest_span("roots", "members")).withColumn("size", F.size("members"))
    c = rows.groupBy("members", "size").agg(F.count("*").alias("n"), F.count_if(F.col("width") == F.col("size")).alias("tight"), F.count_if(F.col("width") <= span).alias("near"))
    return c.select("members", kind(share).alias("kind"))


def kind(share: float = 0.5) -> Column:
    """The kind of (size, n, tight, near): ``n`` occurrences, of which so many stand side by side, and so many near."""
    return F.when(F.col("tight") > share * F.col("n"), "phrase").when((F.col("size") >= 3) & (F.col("near") > share * F.col("n")), "frame").otherwise("constellation")


def edges(order: DataFrame, chapters: DataFrame, end: float = 0.15, least: int = 4) -> DataFrame:
    """``order`` with ``edge``: 1 in the first ``end`` of a book's chapters, 2 in the last, 3 in both, else 0; books of ``least`` chapters or more."""
    reach = F.ceil(F.lit(end) * F.col("n_chapters"))
    first, last = F.col("chapter") <= reach, F.col("chapter") > F.col("n_chapters") - reach
    x = order.join(chapters, "book").where(F.col("n_chapters") >= least)
    return x.withColumn("edge", first.cast("int") + 2 * last.cast("int")).drop("n_chapters")
