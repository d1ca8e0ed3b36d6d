"""Judgements: how two passages agree, when one book stands to another, which translations keep an echo, which predictions hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quillmark.functions.sequences import lcs

SLACK = 25


def verdict(pairs: DataFrame) -> DataFrame:
    """Adds ``verdict`` to pairs with the content units ``ua`` and ``ub`` of two passages."""
    x = pairs.withColumn("k", lcs("ua", "ub")).withColumn("n", F.least(F.size("ua"), F.size("ub"))).withColumn("both", F.size(F.array_intersect("ua", "ub")))
    v = F.when(F.col("n") == 0, "departs").when((F.col("k") == F.col("n")) & (F.size("ua") == F.size("ub")), "whole").when((F.col("k") == F.col("n") - 1) & (F.col("n") >= 3), "one word changed")
    v = v.when(F.col("k") == F.col("n"), "held inside").when((F.col("both") >= 2) & (F.col("k") < F.col("both")), F.concat(F.lit("same words, other order ("), F.col("both").cast("string"), F.lit(" roots)"))).when(F.col("k") >= 3, "formula").otherwise("departs")
    return x.withColumn("verdict", v).drop("k", "n", "both")


def in_time(a: Column, b: Column, slack: int = SLACK) -> Column:
    """Whether a partner of date ``b`` is earlier than, contemporary with or later than one of date ``a`` (years, BC negative); ? where a date is missing."""
    return F.when(a.isNull() | b.isNull(), "?").when(b < a - slack, "earlier").when(b > a + slack, "later").otherwise("contemporary")


def in_time_disputed(a: Column, b: Column, a_critical: Column, b_critical: Column) -> Column:
    """The same, marked where the critical dates put the partner on another side."""
    label, other = in_time(a, b), in_time(F.coalesce(a_critical, a), F.coalesce(b_critical, b))
    return F.when((label != "?") & (label != other), F.concat(label, F.lit(" (disputed)"))).otherwise(label)


def support(echoes: DataFrame, texts: DataFrame) -> DataFrame:
    """(echo, kept, asked): in how many translations both verses of an echo (echo, verse_a, verse_b) share a run of its length.

    ``texts`` has (translation, verse_id, runs); a translation is asked where it has both verses.
    """
    a, b = texts.select("translation", F.col("verse_id").alias("verse_a"), F.col("runs").alias("ra")), texts.select("translation", F.col("verse_id").alias("verse_b"), F.col("runs").alias("rb"))
    x = echoes.join(a, "verse_a").join(b, ["translation", "verse_b"])
    return x.groupBy("echo").agg(F.count_if(F.arrays_overlap("ra", "rb")).alias("kept"), F.count("*").alias("asked"))


def majority(uses: DataFrame, holy: str = "sacred") -> DataFrame:
    """(root, category): the category with the largest share of a root's uses; ``holy`` wins from half on. Of equals the first by name."""
    n = uses.groupBy("root", "category").agg(F.count("*").alias("n"))
    g = n.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("n"), "category")).alias("b"), F.sum("n").alias("total"), F.sum(F.when(F.col("category") == holy, F.col("n")).otherwise(0)).alias("h"))
    return g.select("root", F.when(F.col("h") * 2 >= F.col("total"), F.lit(holy)).otherwise(F.col("b.category")).alias("category"))


def assign(shares: DataFrame, floor: float) -> DataFrame:
    """(name, context): each name takes the context with the largest share of its words, from ``floor`` on, and no context goes twice."""
    best = Window.partitionBy("name").orderBy(F.desc("share"), "context")
    first = shares.where(F.col("share") >= floor).withColumn("k", F.row_number().over(best)).where("k = 1")
    owner = Window.partitionBy("context").orderBy(F.desc("share"), "name")
    return first.withColumn("o", F.row_number().over(owner)).where("o = 1").select("name", "context")


def predictions(expected: DataFrame, found: DataFrame, near: int = 3) -> DataFrame:
    """(prediction, judgement): hit where a found stretch (book, first, last) overlaps the predicted one, near where it lies within ``near`` places, else miss."""
    f = found.select(F.col("book").alias("b"), F.col("first").alias("f"), F.col("last").alias("l"))
    x = expected.join(f, (F.col("book") == F.col("b")) & (F.col("f") <= F.col("last") + near) & (F.col("l") >= F.col("first") - near), "left")
    hit = (F.col("f") <= F.col("last")) & (F.col("l") >= F.col("first"))
    return x.groupBy("prediction").agg(F.max(F.when(hit, 2).when(F.col("f").isNotNull(), 1).otherwise(0)).alias("k")).select("prediction", F.when(F.col("k") == 2, "hit").when(F.col("k") == 1, "near").otherwise("miss").alias("judgement"))


def lost_verses(known: DataFrame, held: DataFrame) -> DataFrame:
    """(version, verse_id): verses a version's tradition has and its source lacks."""
    return known.join(held, ["version", "verse_id"], "left_anti").select("version", "verse_id")


def bootstrap(values: DataFrame, by: str, value: str, times: int = 200, seed: int = 11) -> DataFrame:
    """(group, mean, low, high): means with the range of the middle 95 % of seeded resamples.

    How often a row is drawn in a resample is a Poisson number from a hash of its id, so resamples are made without moving rows.
    """
    u = (F.pmod(F.xxhash64("id", "trial", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    draws = F.when(u < 0.36788, 0).when(u < 0.73576, 1).when(u < 0.91970, 2).when(u < 0.98101, 3).when(u < 0.99634, 4).otherwise(5)
    x = values.select("id", by, F.col(value).cast("double").alias("v")).where("v is not null").withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("d", draws)
    m = x.groupBy(by, "trial").agg((F.sum(F.col("d") * F.col("v")) / F.nullif(F.sum("d"), F.lit(0))).alias("m"))
    real = values.groupBy(by).agg(F.avg(value).alias("mean"))
    return m.groupBy(by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).join(real, by).select(by, "mean", "low", "high")


def balanced_limit(counts: DataFrame) -> DataFrame:
    """The limit of uses up to which a root is rare such that the share of rare words differs least between two layers: (limit, gap).

    ``counts`` has (layer, root, weight) of two layers; the limits tried are the weights that occur up to 50.
    """
    w = counts.groupBy("root").agg(F.sum("weight").alias("w"))
    x = counts.join(w, "root").groupBy("layer", F.least("w", F.lit(51)).alias("w")).agg(F.sum("weight").alias("n"))
    run = Window.partitionBy("layer").orderBy("w")
    total = x.groupBy("layer").agg(F.sum("n").alias("t"))
    c = x.withColumn("c", F.sum("n").over(run)).join(total, "layer").select("layer", F.col("w").alias("at"), "c", "t")
    c = c.withColumn("w", F.explode(F.sequence(F.least(F.col("at"), F.lit(50)), F.lit(50)))).where("at <= w").groupBy("layer", "w").agg((F.max("c") / F.max("t")).alias("s"))
    share = c.groupBy("w").agg((F.max("s") - F.min("s")).alias("gap"))
    return share.orderBy("gap", "w").limit(1).select(F.col("w").alias("limit"), "gap")


def join_number(words: list[str], parts: dict[str, int]) -> list[int]:
    """Values of the number words in a row of words; parts of one number ('twenty', 'and', 'five') are joined, 'hundred' multiplies."""
    out: list[int] = []
    here: int | None = None
    for i, w in enumerate([*words, ""]):
        if w in parts:
            v = parts[w]
            here = v if here is None else here * v if v >= 100 else here + v
        elif w == "and" and here is not None and i + 1 < len(words) and words[i + 1] in parts:
            continue
        elif here is not None:
            out.append(here)
            here = None
    return out


def half_verses(marks: DataFrame) -> DataFrame:
    """(verse_id, split): the word after which a verse divides: the last ole-weyored, else atnach, else the middle."""
    m = marks.groupBy("verse_id").agg(F.max(F.when(F.col("mark") == "ole", F.col("position"))).alias("o"), F.max(F.when(F.col("mark") == "atnach", F.col("position"))).alias("a"), F.max("position").alias("n"))
    return m.select("verse_id", F.coalesce("o", "a", F.floor(F.col("n") / 2).cast("int")).alias("split"))
