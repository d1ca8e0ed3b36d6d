"""Tags of words: placing drifted tags, inferring missing ones, absorbing a word into its neighbour."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from quillmark.operators.corpus import ROOT

REACH = 8


def usual_number(tokens: DataFrame, least: int = 3) -> DataFrame:
    """(surface, book, root, uses, total): the number a spelling usually bears in a book, with half or more of at least ``least`` tagged uses."""
    t = tokens.where(F.col("surface").isNotNull() & ~F.col("is_stop") & F.col("root").rlike(ROOT))
    n = t.groupBy("surface", "book", "root").agg(F.count("*").alias("n"))
    best = n.groupBy("surface", "book").agg(F.min(F.struct((-F.col("n")).alias("n"), "root")).alias("b"), F.sum("n").alias("total"))
    out = best.select("surface", "book", F.col("b.root").alias("root"), (-F.col("b.n")).alias("uses"), "total")
    return out.where((F.col("total") >= least) & (F.col("uses") * 2 >= F.col("total")))


def infer(tokens: DataFrame) -> DataFrame:
    """Untagged content words with the number usual in their book, else in all the text, as ``inferred``."""
    here = usual_number(tokens).select("surface", "book", F.col("root").alias("in_book"))
    everywhere = usual_number(tokens.withColumn("book", F.lit(""))).select("surface", F.col("root").alias("in_text"))
    bare = tokens.where(F.col("surface").isNotNull() & ~F.col("is_stop") & ~F.coalesce(F.col("root").rlike(ROOT), F.lit(False)))
    out = bare.join(here, ["surface", "book"], "left").join(everywhere, "surface", "left")
    return out.select("verse_id", "position", "surface", F.coalesce("in_book", "in_text").alias("inferred")).where("inferred is not null")


def usual_company(tokens: DataFrame, least: int = 5, share: float = 0.6) -> DataFrame:
    """(surface, mate, uses, total): the tagged word that an untagged one stands beside in ``share`` of at least ``least`` uses."""
    t = tokens.where("surface is not null").withColumn("tagged", F.coalesce(F.col("root").rlike(ROOT), F.lit(False)) & ~F.col("is_stop"))
    w = Window.partitionBy("verse_id").orderBy("position")
    number = F.when(F.col("tagged"), F.col("root"))
    x = t.select("surface", "tagged", "is_stop", F.lag(number).over(w).alias("before"), F.lead(number).over(w).alias("after")).where("not tagged and not is_stop")
    total = x.groupBy("surface").agg(F.count("*").alias("total")).where(F.col("total") >= least)
    mates = x.select("surface", F.explode(F.array_distinct(F.array_compact(F.array("before", "after")))).alias("mate")).groupBy("surface", "mate").agg(F.count("*").alias("n"))
    best = mates.groupBy("surface").agg(F.min(F.struct((-F.col("n")).alias("n"), "mate")).alias("b")).join(total, "surface")
    out = best.select("surface", F.col("b.mate").alias("mate"), (-F.col("b.n")).alias("uses"), "total")
    return out.where(F.col("uses") >= share * F.col("total"))


def place_tags(words: list[str], tags: list[tuple[int, str]], fits=None, reach: int = REACH) -> dict[int, str]:
    """Places of one verse's tags ``(stated position, number)``: the nearest free word within ``reach`` of where the drift so far puts it.

    ``fits`` tells whether a number suits a word; where no word suits, the nearest free one is taken. Of equal distance the later.
    """
    taken: dict[int, str] = {}
    drift = 0
    for stated, number in sorted(tags):
        at = stated + drift
        near = sorted((i for i in range(len(words)) if i not in taken and abs(i - at) <= reach), key=lambda i: (abs(i - at), -i))
        suits = [i for i in near if fits is None or fits(words[i], number)]
        if pick := suits or near:
            taken[pick[0]] = number
            drift = pick[0] - stated
    return taken


def place_tags_by_verse(words: DataFrame, tags: DataFrame) -> DataFrame:
    """``place_tags`` for each verse of words (verse_id, position, surface) and tags (verse_id, stated, number); a verse is a task's group."""
    schema = "verse_id long, position int, number string"

    def run(key, w: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        w = w.sort_values("position")
        got = place_tags(w["surface"].tolist(), list(zip(t["stated"], t["number"])))
        return pd.DataFrame({"verse_id": [key[0]] * len(got), "position": [int(w["position"].iloc[i]) for i in got], "number": list(got.values())}).astype({"verse_id": "int64", "position": "int32"})

    return words.groupBy("verse_id").cogroup(tags.groupBy("verse_id")).applyInPandas(run, schema)


def allowed(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """Occurrences that no rule forbids. A rule (root, gloss, book, chapter_from, chapter_to) forbids its root where its gloss isn't part of
    the word's ``gloss``, and where it names a book, outside those chapters; a null gloss or book asks nothing. Rules are a short list by hand.
    """
    r = rules.select(F.col("root").alias("r_root"), F.col("gloss").alias("r_gloss"), F.col("book").alias("r_book"), "chapter_from", "chapter_to")
    no_gloss = F.col("r_gloss").isNotNull() & ~F.coalesce(F.contains(F.lower("gloss"), F.lower("r_gloss")), F.lit(False))
    elsewhere = F.col("r_book").isNotNull() & ~(F.col("book").eqNullSafe(F.col("r_book")) & F.coalesce(F.col("chapter").between(F.col("chapter_from"), F.col("chapter_to")), F.lit(False)))
    return tokens.join(r, (F.col("root") == F.col("r_root")) & (no_gloss | elsewhere), "left_anti")
