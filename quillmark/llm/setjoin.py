"""All similar pairs between set-valued records: an extended-prefix join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillmark.session import cut_lineage

#: Counters of the frequency order; a bound on what it holds, not on the vocabulary. Two terms in one counter share a frequency.
COUNTERS = 1 << 14
#: Pairs with a larger set than this meet in combinations of two terms at most, since longer ones of long prefixes are too many.
LONG = 60
#: Combinations grow by a term until this many records are expected to share one.
SHARED = 32.0
#: Terms of the longest combination.
LONGEST = 3


class SetClasses:
    """Distinct sets of a table ``(id, items)``: classes of equal sets, their representatives and the members of each."""

    def __init__(self, sets: DataFrame, min_size: int):
        rows = sets.where("id is not null and items is not null").groupBy("id").agg(F.max(F.array_sort(F.array_distinct(F.array_compact("items")))).alias("items"))
        rows = rows.where(F.size("items") >= max(1, min_size))
        self.rows = rows.select("id", "items", F.unhex(F.md5(F.to_json("items"))).alias("digest"))
        self.members = self.rows.select("id", "digest")
        self.classes = cut_lineage(self.rows.groupBy("digest").agg(F.min("id").alias("rep"), F.first("items").alias("items"), F.count("*").alias("copies")))


def similar_classes(classes: DataFrame, num: int = 4, den: int = 5, least: int = 1) -> DataFrame:
    """Pairs of classes (digest, rep, items) whose sets have Jaccard similarity of at least ``num`` / ``den``.

    Terms of a set are ordered from rare to common. Two similar sets share at least l terms of their l-prefixes (size - needed + l
    terms), for every l up to the overlap that is needed. The rarest term x they share lies in both 1-prefixes; how long a combination
    is joined on depends on how common x is, so both sides choose the same length: a rare x alone, a commoner one with one or two
    later terms of the longer prefix. Candidates are verified on the whole sets.

    A pair is met in one of three ways, by its two sizes. Where the smaller set alone needs ``LONGEST`` terms, as above; where the larger
    set has more than ``LONG`` members, in combinations of two at most; and where the smaller set needs fewer terms, in
    combinations of no more than the overlap the two sizes need, made for each size of a partner. ``least`` is the smallest size there is.

    Out come ``digest_a``, ``digest_b`` (of rep_a < rep_b), ``rep_a``, ``rep_b``, ``overlap``, ``size_a``, ``size_b``.
    """
    n_classes = classes.count()
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(COUNTERS)).cast("int")
    per = classes.select(F.explode("items").alias("t")).groupBy(bucket(F.col("t")).alias("b")).agg(F.count("*").alias("c"))
    every = classes.sparkSession.range(COUNTERS).withColumnRenamed("id", "b").join(per, "b", "left")
    frequency = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", F.coalesce("c", F.lit(0)).alias("c")))), lambda x: x["c"]).alias("f"))
    rows = classes.select("rep", "items", F.size("items").alias("n")).withColumn("f", frequency.scalar())
    ordered = F.array_sort(F.transform("items", lambda t: F.struct(F.element_at(F.col("f"), bucket(t) + 1).alias("df"), t.alias("t"))))
    rows = rows.select("rep", "n", ordered.alias("o"))
    few = (LONGEST - 1) * den // num  # sets up to this size need fewer terms than the longest combination
    rows = rows.withColumn("p", (F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1).cast("int"))
    joined = []
    if few < LONG:
        plain = rows.where((F.col("n") > few) & (F.col("n") <= LONG)).select("rep", "n", F.explode(_combinations(n_classes, F.lit(LONGEST))).alias("key"))
        joined.append(_candidates(plain, num, den, None))
    long = rows.where((F.col("n") * den > LONG * num) & (F.col("n") > few)).select("rep", "n", F.explode(_combinations(n_classes, F.lit(2))).alias("key"))
    joined.append(_candidates(long, num, den, F.greatest("n_a", "n_b") > LONG))
    if least * num <= few * den:
        joined.append(_small(rows, n_classes, num, den, few))
    found = joined[0]
    for j in joined[1:]:
        found = found.unionByName(j)
    found = found.distinct()
    a = classes.select(F.col("rep").alias("rep_a"), F.col("digest").alias("digest_a"), F.col("items").alias("items_a"))
    b = classes.select(F.col("rep").alias("rep_b"), F.col("digest").alias("digest_b"), F.col("items").alias("items_b"))
    out = found.join(a, "rep_a").join(b, "rep_b").withColumn("overlap", F.size(F.array_intersect("items_a", "items_b")))
    out = out.withColumns({"size_a": F.size("items_a"), "size_b": F.size("items_b")})
    return out.where(F.col("overlap") * den >= num * (F.col("size_a") + F.col("size_b") - F.col("overlap"))).drop("items_a", "items_b")


def _combinations(n: int, most: Column) -> Column:
    """Hashes of the combinations of up to ``most`` terms that a set is joined on; ``p`` is the length of its 1-prefix."""
    o, p = F.col("o"), F.col("p")

    def keys(x: Column, i: Column) -> Column:
        df = x["df"].cast("double")
        crowd = df / F.lit(max(1.0, n / 4))  # chance, generously, that another set with x has a given later term too
        two = F.slice(o, i + 2, p + 1 - (i + 1))
        three = F.slice(o, i + 2, p + 2 - (i + 1))
        pairs = F.transform(two, lambda y: F.xxhash64(F.lit(2), x["t"], y["t"]))
        triples = F.flatten(F.transform(three, lambda y, j: F.transform(F.slice(o, i + j + 3, p + 2 - (i + j + 2)), lambda z: F.xxhash64(F.lit(3), x["t"], y["t"], z["t"]))))
        return F.when((df <= SHARED) | (most == 1), F.array(F.xxhash64(F.lit(1), x["t"]))).when((df * crowd <= SHARED) | (most == 2), pairs).otherwise(triples)

    return F.flatten(F.transform(F.slice(o, 1, p), keys))


def _candidates(keys: DataFrame, num: int, den: int, sizes: Column | None) -> DataFrame:
    a = keys.select("key", F.col("rep").alias("rep_a"), F.col("n").alias("n_a"))
    b = keys.select("key", F.col("rep").alias("rep_b"), F.col("n").alias("n_b"))
    near = (F.col("rep_a") < F.col("rep_b")) & (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    if sizes is not None:
        near = near & sizes
    return a.join(b, "key").where(near).select("rep_a", "rep_b")


def _small(rows: DataFrame, n_classes: int, num: int, den: int, few: int) -> DataFrame:
    """Candidates whose smaller set has at most ``few`` members: joined by combination and both sizes, the smaller set against the larger."""
    n, s = F.col("n"), F.col("s")
    partners = F.sequence(F.ceil(n * num / F.lit(den)).cast("int"), F.floor(n * den / F.lit(num)).cast("int"))
    each = rows.where(n * num <= few * den).withColumn("s", F.explode(partners)).where(F.least("n", "s") <= few)
    needed = F.ceil((n + s) * num / F.lit(num + den)).cast("int")
    each = each.withColumn("p", n - needed + 1).withColumn("most", F.least(needed, F.lit(LONGEST)))
    keys = each.select("rep", "n", "s", F.explode(_combinations(n_classes, F.col("most"))).alias("key"))
    a = keys.where(n <= s).select("key", F.col("rep").alias("x"), F.col("n").alias("low"), F.col("s").alias("high"))
    b = keys.where(n >= s).select("key", F.col("rep").alias("y"), F.col("s").alias("low"), F.col("n").alias("high"))
    met = a.join(b, ["key", "low", "high"]).where((F.col("x") < F.col("y")) | ((F.col("low") < F.col("high")) & (F.col("x") != F.col("y"))))
    return met.select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"))


def similar_pairs(sets: DataFrame, min_size: int, num: int = 4, den: int = 5) -> DataFrame:
    """All pairs ``id_a`` < ``id_b`` of records whose sets are similar, with ``overlap``, ``size_a`` and ``size_b``.

    Null ids, null sets, null members and sets under ``min_size`` take no part; ids that occur in several rows count once, with
    the greatest of their sets; records with equal sets are compared as one class and only here expanded into pairs.
    An empty input gives an empty result.
    """
    c = SetClasses(sets, min_size)
    between = similar_classes(c.classes, num, den, min_size).select("digest_a", "digest_b", "overlap", "size_a", "size_b")
    same = c.classes.where("copies > 1").select("digest", F.size("items").alias("size"))
    same = same.select(F.col("digest").alias("digest_a"), F.col("digest").alias("digest_b"), F.col("size").alias("overlap"), F.col("size").alias("size_a"), F.col("size").alias("size_b"))
    ma = c.members.select(F.col("digest").alias("digest_a"), F.col("id").alias("x"))
    mb = c.members.select(F.col("digest").alias("digest_b"), F.col("id").alias("y"))
    out = between.unionByName(same).join(ma, "digest_a").join(mb, "digest_b")
    out = out.where((F.col("digest_a") != F.col("digest_b")) | (F.col("x") < F.col("y")))
    swap = F.col("x") > F.col("y")
    return out.select(
        F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "overlap",
        F.when(swap, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"), F.when(swap, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"),
    )


def similar_links(sets: DataFrame, min_size: int, num: int = 4, den: int = 5) -> DataFrame:
    """One row per record: ``id``, ``class_id`` (smallest id with the same set), ``copies`` in the class and ``links`` to other classes."""
    c = SetClasses(sets, min_size)
    pairs = similar_classes(c.classes, num, den, min_size)
    ends = pairs.select(F.explode(F.array("digest_a", "digest_b")).alias("digest")).groupBy("digest").agg(F.count("*").alias("links"))
    classes = c.classes.select("digest", F.col("rep").alias("class_id"), "copies").join(ends, "digest", "left")
    return c.members.join(classes, "digest").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
