"""Sliding windows of verses: measures along a book, scales, and the spots where a measure runs hot or cold."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from quillmark.functions import measures as M
from quillmark.functions.lists import STRIP, VARIETY_SPAN

#: Verses in one task's stretch of a book; a long book is cut into stretches that overlap by a window.
BLOCK = 4096


def numbered(verses: DataFrame) -> DataFrame:
    """``verses`` with ``i``, the verse's place in its book.

    Places inside a chapter are ranked there and shifted by the verses of the chapters before, so a large book is never sorted in one task.
    """
    sizes = verses.groupBy("book", "chapter").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("book").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("book", "chapter", before.alias("shift"))
    book_size = verses.groupBy("book").agg(F.count("*").alias("book_size"))
    place = F.row_number().over(Window.partitionBy("book", "chapter").orderBy("verse", "verse_id")) - 1
    return verses.withColumn("p", place).join(sizes, ["book", "chapter"]).join(book_size, "book").withColumn("i", F.col("p") + F.col("shift")).drop("p", "shift")


def verse_facts(verses: DataFrame, tokens: DataFrame, rare: DataFrame, action: str = r"^[HG]?V|^HV|^V") -> DataFrame:
    """Per verse: words, content words, rare roots, verbs, and the content roots in order."""
    t = tokens.join(rare.select("root", F.lit(1).alias("rare")), "root", "left")
    held = F.col("root").isNotNull() & ~F.col("is_stop")
    n = t.groupBy("verse_id").agg(
        F.count("*").alias("words"), F.count_if(held).alias("content"), F.count_if(held & F.col("rare").isNotNull()).alias("rare"),
        F.count_if(held & F.coalesce(F.col("morph").rlike(action), F.lit(False))).alias("verbs"),
        F.transform(F.array_sort(F.collect_list(F.when(held, F.struct("position", "root")))), lambda x: x["root"]).alias("roots"),
    )
    zero = F.lit(0).cast("long")
    out = verses.join(n, "verse_id", "left")
    return out.select(*verses.columns, *(F.coalesce(c, zero).alias(c) for c in ("words", "content", "rare", "verbs")), F.coalesce("roots", F.array().cast("array<string>")).alias("roots"))


def windows(facts: DataFrame, size: int = STRIP, step: int = 1) -> DataFrame:
    """(book, start, verses, words, content, rare, verbs, roots): windows of ``size`` verses, moving by ``step``; a shorter book is one window."""
    rows = numbered(facts)
    here, back = F.floor(F.col("i") / BLOCK), F.floor((F.col("i") - size + 1) / BLOCK)
    rows = rows.withColumn("block", F.explode(F.when((back < here) & (here > 0), F.array(here, here - 1)).otherwise(F.array(here))))
    w = Window.partitionBy("book", "block").orderBy("i").rowsBetween(0, size - 1)
    sums = [F.sum(c).over(w).alias(c) for c in ("words", "content", "rare", "verbs")]
    out = rows.select("book", "i", "block", "book_size", F.count("*").over(w).alias("verses"), *sums, F.flatten(F.collect_list("roots").over(w)).alias("roots"))
    out = out.where((F.floor(F.col("i") / BLOCK) == F.col("block")) & (F.col("i") % step == 0) & ((F.col("verses") == size) | ((F.col("i") == 0) & (F.col("book_size") < size))))
    return out.select("book", F.col("i").alias("start"), "verses", "words", "content", "rare", "verbs", "roots")


def moving_variety(items: list, span: int = VARIETY_SPAN) -> float:
    """Mean share of distinct items over all runs of ``span``; the share itself where there are no more than that."""
    if not items:
        return 0.0
    if len(items) <= span:
        return len(set(items)) / len(items)
    held: dict = {}
    total = 0.0
    for i, x in enumerate(items):
        held[x] = held.get(x, 0) + 1
        if i >= span:
            y = items[i - span]
            held[y] -= 1
            if not held[y]:
                del held[y]
        if i >= span - 1:
            total += len(held) / span
    return total / (len(items) - span + 1)


@F.pandas_udf(DoubleType())
def variety(items: pd.Series) -> pd.Series:
    return items.map(lambda x: moving_variety(list(x)))


@F.pandas_udf(DoubleType())
def normal_place(share: pd.Series) -> pd.Series:
    """The point of the bell curve below which ``share`` lies, kept within 0.0005 and 0.9995."""
    n = NormalDist()
    return share.map(lambda p: n.inv_cdf(min(max(p, 0.0005), 0.9995)))


def hammer(wins: DataFrame) -> DataFrame:
    """(book, start, hammer_root, top): the root a window repeats most; of equals the first by code point."""
    n = wins.select("book", "start", F.explode("roots").alias("root")).groupBy("book", "start", "root").agg(F.count("*").alias("n"))
    return n.groupBy("book", "start").agg(F.min(F.struct((-F.col("n")).alias("n"), "root")).alias("b")).select("book", "start", F.col("b.root").alias("hammer_root"), (-F.col("b.n")).alias("top"))


def counted(wins: DataFrame) -> DataFrame:
    """(book, start, measure, k, n, score) of the strips that are shares of counted words."""
    parts = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(k).alias("k"), F.col(n).alias("n")) for m, k, n in (("density", "content", "words"), ("rare", "rare", "content"), ("action", "verbs", "content"))))
    out = wins.select("book", "start", F.explode(parts).alias("x")).select("book", "start", "x.*")
    return out.withColumn("score", F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(F.lit(0.0)))


def z_scale(strips: DataFrame) -> DataFrame:
    """``z`` of each score among the windows of all books."""
    s = strips.groupBy("measure").agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"))
    return strips.join(s, "measure").withColumn("z", F.when(F.col("sd") > 0, (F.col("score") - F.col("m")) / F.col("sd")).otherwise(F.lit(0.0))).drop("m", "sd")


def percentile_scale(strips: DataFrame) -> DataFrame:
    """``percentile`` with ties counted half. Windows are counted by score first, so what is ordered are the distinct scores."""
    c = strips.groupBy("measure", "score").agg(F.count("*").alias("equal"))
    below = F.coalesce(F.sum("equal").over(Window.partitionBy("measure").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("below", below).join(strips.groupBy("measure").agg(F.count("*").alias("all")), "measure")
    return strips.join(c.select("measure", "score", M.mid_rank("below", "equal", "all").alias("percentile")), ["measure", "score"])


def g2_scale(strips: DataFrame) -> DataFrame:
    """Signed root of the log-likelihood of a window's count against the rate of all windows."""
    t = strips.groupBy("measure").agg(F.sum("k").alias("all_k"), F.sum("n").alias("all_n"))
    g = M.g2("k", "all_k", "n", "all_n")
    return strips.join(t, "measure").withColumn("z", F.signum(g) * F.sqrt(F.abs(g))).drop("all_k", "all_n")


def spots(scaled: DataFrame, threshold: float = 2.0, size: int = STRIP) -> DataFrame:
    """(book, measure, hot, first, last, windows, peak_start, peak): runs of windows past the threshold.

    Runs of one kind whose nearest windows share at least half a window of verses are one spot. Only windows past the threshold are ordered.
    """
    rows = scaled.withColumn("hot", F.when(F.col("z") >= threshold, True).when(F.col("z") <= -threshold, False)).where("hot is not null")
    w = Window.partitionBy("book", "measure", "hot").orderBy("start")
    apart = F.col("start") - F.lag("start").over(w) > max(1, size - math.ceil(size / 2))
    rows = rows.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("spot", F.sum("new").over(w))
    peak = F.max(F.struct(F.abs("z").alias("a"), (-F.col("start")).alias("s"), F.col("z").alias("z")))
    out = rows.groupBy("book", "measure", "hot", "spot").agg(F.min("start").alias("first"), F.max("start").alias("last"), F.count("*").alias("windows"), peak.alias("p"))
    return out.select("book", "measure", "hot", "first", (F.col("last") + size - 1).alias("last"), "windows", (-F.col("p.s")).alias("peak_start"), F.col("p.z").alias("peak"))


def bands(scaled: DataFrame, warm: float, hot: float, size: int = STRIP) -> DataFrame:
    """(book, measure, band, first, last, windows, peak_start, peak): hot, warm and cool spots.

    Hot and cool spots are windows past ``hot``, joined as ``spots`` joins them. A warm spot is made of runs of windows past ``warm`` that never reach
    ``hot`` and share no verse with a hot window, so the slopes of a hot spot are no spots of their own. Only windows past ``warm`` are ordered.
    """
    outer = spots(scaled, hot, size).withColumn("band", F.when(F.col("hot"), "hot").otherwise("cool"))
    above = scaled.where(F.col("z") >= warm)
    w = Window.partitionBy("book", "measure").orderBy("start")
    run = above.withColumn("run", F.col("start") - F.row_number().over(w))
    ends = run.groupBy("book", "measure", "run").agg(F.min("start").alias("a"), F.max("start").alias("b"), F.max("z").alias("most")).where(F.col("most") < hot)
    strong = above.where(F.col("z") >= hot).select(F.col("book").alias("hb"), F.col("measure").alias("hm"), F.col("start").alias("h"))
    near = (F.col("book") == F.col("hb")) & (F.col("measure") == F.col("hm")) & (F.col("h") >= F.col("a") - (size - 1)) & (F.col("h") <= F.col("b") + size - 1)
    kept = run.join(ends.join(strong, near, "left_anti").select("book", "measure", "run"), ["book", "measure", "run"], "left_semi").select("book", "measure", "start", "z")
    inner = spots(kept, warm, size).withColumn("band", F.lit("warm"))
    return outer.unionByName(inner).select("book", "measure", "band", "first", "last", "windows", "peak_start", "peak")
