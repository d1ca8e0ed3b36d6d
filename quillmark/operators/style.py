"""Lift against peers, Burrows' Delta, richness and other measures of a book's manner."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from quillmark.functions import measures as M
from quillmark.operators.order import places


def peers(books: DataFrame) -> DataFrame:
    """(book, peer): the other books of its group in its testament, or of the testament where the group has fewer than two others.

    The book list is a reference table; its pairs are bounded by its square.
    """
    b = books.where("testament is not null")
    p = b.select(F.col("book").alias("peer"), "testament", F.col("baseline_group").alias("peer_group"))
    pairs = b.join(p, "testament").where("book <> peer").withColumn("own", F.col("baseline_group").eqNullSafe(F.col("peer_group")) & F.col("baseline_group").isNotNull())
    pairs = pairs.withColumn("n", F.sum(F.col("own").cast("int")).over(Window.partitionBy("book")))
    return pairs.where("own or n < 2").select("book", "peer")


def book_lift(counts: DataFrame, books: DataFrame, sizes: DataFrame, cushion: float = 2.0) -> DataFrame:
    """(book, root, observed, expected, lift) for the roots of each book; expected from the rate of its peers, itself left out.

    ``sizes`` (book, own) are all words of the books.
    """
    size = sizes.select("book", F.col("own").alias("total"))
    p = peers(books)
    peer_size = p.join(size.withColumnRenamed("book", "peer"), "peer").groupBy("book").agg(F.sum("total").alias("peer_total"))
    peer_counts = p.join(counts.select(F.col("book").alias("peer"), "root", F.col("weight").alias("w")), "peer").groupBy("book", "root").agg(F.sum("w").alias("peer_weight"))
    out = counts.join(size, "book").join(peer_size, "book").join(peer_counts, ["book", "root"], "left")
    expected = F.coalesce("peer_weight", F.lit(0)) * F.col("total") / F.col("peer_total")
    return out.select("book", "root", F.col("weight").alias("observed"), expected.alias("expected"), M.lift("weight", expected, cushion).alias("lift"))


def features(words: DataFrame, n: int = 150, share: float = 0.5) -> DataFrame:
    """(feature): the ``n`` most frequent words (book, word, weight) that stand in at least ``share`` of the books."""
    books = words.agg(F.count_distinct("book")).scalar()
    f = words.groupBy("word").agg(F.sum("weight").alias("w"), F.count("*").alias("b")).where(F.col("b") >= F.ceil(F.lit(share) * books))
    return f.orderBy(F.desc("w"), "word").limit(n).select(F.col("word").alias("feature"))


def rates(words: DataFrame, chosen: DataFrame) -> DataFrame:
    """(book, feature, rate) per thousand words, zero where a book lacks the feature; books times features rows."""
    size = words.groupBy("book").agg(F.sum("weight").alias("total"))
    counts = words.join(chosen, words["word"] == chosen["feature"]).select("book", "feature", "weight")
    grid = size.withColumn("all", chosen.agg(F.collect_list("feature")).scalar()).select("book", "total", F.explode("all").alias("feature"))
    return grid.join(counts, ["book", "feature"], "left").select("book", "feature", (1000 * F.coalesce("weight", F.lit(0)) / F.col("total")).alias("rate"))


def z_scores(rate: DataFrame) -> DataFrame:
    s = rate.groupBy("feature").agg(F.avg("rate").alias("m"), F.stddev_samp("rate").alias("sd"))
    return rate.join(s, "feature").where("sd > 0").select("book", "feature", ((F.col("rate") - F.col("m")) / F.col("sd")).alias("z"))


def delta(z: DataFrame) -> DataFrame:
    """(book_a, book_b, delta): mean difference of z-scores over the features, for each pair once."""
    a, b = z.select("feature", F.col("book").alias("book_a"), F.col("z").alias("za")), z.select("feature", F.col("book").alias("book_b"), F.col("z").alias("zb"))
    return a.join(b, "feature").where("book_a < book_b").groupBy("book_a", "book_b").agg(F.avg(F.abs(F.col("za") - F.col("zb"))).alias("delta"))


def yardstick(values: DataFrame, value: str, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(share, value): the value at place int(share * n) of the sorted values, without interpolation."""
    n = values.agg(F.count("*")).scalar()
    ranked = places(values.select(value), [F.col(value)], "i").withColumn("n", n)
    share = F.explode(F.array(*map(F.lit, shares)))
    return ranked.withColumn("share", share).where(F.col("i") == F.least(F.col("n") - 1, F.floor(F.col("share") * F.col("n")))).select("share", value)


def chi2_quantile(p: float, k: float) -> float:
    """Quantile of the chi-squared distribution with ``k`` degrees of freedom, by bisection of the regularised gamma function."""
    if k <= 0:
        return 0.0
    a = k / 2

    def lower(x: float) -> float:
        if x <= 0:
            return 0.0
        if x < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-15:
                n += 1
                term *= x / n
                total += term
            return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
        b = x + 1 - a
        c, d = 1e300, 1 / b
        h = d
        for i in range(1, 10000):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h

    lo, hi = 0.0, 2 * (a + 10 * math.sqrt(a + 1) + 30)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if lower(mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def poisson_range(observed: int, expected: float, share: float = 0.95) -> tuple[float, float]:
    """Exact interval of observed / expected for a Poisson count."""
    if expected <= 0:
        return 0.0, math.inf
    tail = (1 - share) / 2
    return chi2_quantile(tail, 2 * observed) / 2 / expected, chi2_quantile(1 - tail, 2 * observed + 2) / 2 / expected
