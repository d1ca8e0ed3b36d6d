"""Items that appear together: basket collapsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmark.session import cut_lineage

#: A basket with more frequent items than this is joined with itself instead of being held as one array.
WIDEST = 512


def _numbered(items: DataFrame) -> DataFrame:
    """``items``, materialised, with a ``number`` below 2**31 for each row: its place in its partition, with the partition before it."""
    at = F.monotonically_increasing_id()
    n = items.withColumn("at", at)
    most = n.agg(F.max(F.shiftright("at", 33)), F.max(F.col("at").bitwiseAND((1 << 33) - 1))).first()
    part, row = (int(x or 0).bit_length() for x in most)
    if part + row > 31:
        raise ValueError("more frequent items than 31 bits can number")
    return n.withColumn("number", F.shiftleft(F.shiftright("at", 33), row).bitwiseOR(F.col("at").bitwiseAND((1 << 33) - 1)).cast("int")).drop("at")


def co_occurring(items: DataFrame, basket: str, item: str, min_support: int = 5, min_lift: int = 10, widest: int = WIDEST) -> DataFrame:
    """Pairs of items in at least ``min_support`` baskets and at least ``min_lift`` times as often together as by chance.

    Identical baskets are collapsed into one with a weight, pairs are enumerated once for each distinct basket and the weights
    are added up. Out come ``item_a`` < ``item_b`` (by code point), ``together`` (k), ``with_a`` (a), ``with_b`` (b), ``baskets``
    (N), ``lift`` = k N / (a b) and ``conviction`` = (1 - b / N) / (1 - k / a), null where k = a.

    Only items that can't be in any result are left out: k is at most the smaller of a and b, so a pair with an item in fewer
    than ``min_support`` baskets, or in more than N / ``min_lift``, can't reach the thresholds. That takes out the hot items exactly.
    The items left are numbered, so baskets are arrays of numbers and a pair is one long; names come back with the pairs that count.
    Null baskets and items take no part; an item counts once in a basket; an empty input gives an empty result. Baskets wider
    than ``widest`` items go through a self-join on the basket, which adaptive execution can split, so no array is unbounded.
    """
    rows = items.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct()
    n = rows.agg(F.count_distinct("basket")).scalar()
    support = rows.groupBy("item").agg(F.count("*").alias("support")).withColumn("baskets", n)
    support = support.where((F.col("support") >= min_support) & (F.col("support") * min_lift <= F.col("baskets")))
    support = _numbered(cut_lineage(support))
    kept = rows.join(support.select("item", "number"), "item").select("basket", "number")
    long = items.where(F.col(basket).isNotNull()).groupBy(F.col(basket).alias("basket")).agg(F.count(item).alias("width")).where(F.col("width") > widest)
    any_wide = not long.limit(1).isEmpty()  # rows, copies too, so an upper bound of the width
    narrow = kept
    if any_wide:
        wide = kept.join(long.select("basket"), "basket", "left_semi").groupBy("basket").agg(F.count("*").alias("width")).where(F.col("width") > widest)
        wide = cut_lineage(wide.select("basket"))
        narrow = kept.join(wide, "basket", "left_anti")
    narrow = narrow.groupBy("basket").agg(F.sort_array(F.collect_list("number")).alias("members"))
    collapsed = narrow.where(F.size("members") >= 2).groupBy("members").agg(F.count("*").alias("weight"))
    first = collapsed.select("weight", "members", F.posexplode("members").alias("at", "a"))
    pair = lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))
    pairs = first.select("weight", "a", F.explode(F.slice("members", F.col("at") + 2, F.size("members"))).alias("b")).select("weight", pair(F.col("a"), F.col("b")).alias("pair"))
    if any_wide:
        w = kept.join(wide, "basket", "left_semi")
        a, b = w.select("basket", F.col("number").alias("a")), w.select("basket", F.col("number").alias("b"))
        pairs = pairs.unionByName(a.join(b, "basket").where(F.col("a") < F.col("b")).select(F.lit(1).cast("long").alias("weight"), pair(F.col("a"), F.col("b")).alias("pair")))
    together = pairs.groupBy("pair").agg(F.sum("weight").alias("together")).where(F.col("together") >= min_support)
    together = together.select(F.shiftright("pair", 32).cast("int").alias("x"), F.col("pair").bitwiseAND((1 << 31) - 1).cast("int").alias("y"), "together")
    sx = support.select(F.col("number").alias("x"), F.struct("item", "support").alias("p"), "baskets")
    sy = support.select(F.col("number").alias("y"), F.struct("item", "support").alias("q"))
    out = together.join(sx, "x").join(sy, "y").where(F.col("together") * F.col("baskets") >= min_lift * F.col("p.support") * F.col("q.support"))
    out = out.select("together", "baskets", F.when(F.col("p.item") < F.col("q.item"), F.array("p", "q")).otherwise(F.array("q", "p")).alias("o"))
    out = out.select(F.col("o")[0]["item"].alias("item_a"), F.col("o")[1]["item"].alias("item_b"), "together", F.col("o")[0]["support"].alias("with_a"), F.col("o")[1]["support"].alias("with_b"), "baskets")
    return out.select(
        "*",
        (F.col("together") * F.col("baskets") / (F.col("with_a") * F.col("with_b"))).alias("lift"),
        F.when(F.col("together") < F.col("with_a"), (1 - F.col("with_b") / F.col("baskets")) / (1 - F.col("together") / F.col("with_a"))).alias("conviction"),
    )
