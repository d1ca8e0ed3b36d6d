"""Alignment of two versions of a text by expectation maximisation, and what it tells of renderings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from quillmark.operators.order import places
from quillmark.session import cut_lineage

NULL = "NULL"
#: Pairs that a task may hold at once, and source words whose totals are sent to each task; bounds on memory, without effect on results.
BLOCK, SOURCES = 1 << 21, 1 << 22


def word_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """(verse_id, s, t, n): every target word of a verse with every source word and the NULL word; a verse bounds its pairs."""
    s = source.select("verse_id", F.col("word").alias("s")).distinct()
    s = s.unionByName(s.select("verse_id").distinct().withColumn("s", F.lit(NULL)))
    t = target.groupBy("verse_id", F.col("word").alias("t")).agg(F.count("*").alias("n"))
    return s.join(t, "verse_id")


def _expected(verse: np.ndarray, s: np.ndarray, t: np.ndarray, n: np.ndarray, overs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts of each row, pair of each row, sums of each pair) after as many rounds as there are totals of source words, and one more."""
    place = np.unique(verse, return_inverse=True)[1].ravel()
    in_verse = np.unique(place << 32 | t, return_inverse=True)[1].ravel()
    pair = np.unique(s << 32 | t, return_inverse=True)[1].ravel()
    p, shared = np.ones(len(s)), None
    for over in [None, *overs]:
        if over is not None:
            p = shared[pair] / over[s]
        c = n * p / np.bincount(in_verse, p)[in_verse]
        shared = np.bincount(pair, c)
    return c, pair, shared


def ibm1(pairs: DataFrame, rounds: int = 5) -> DataFrame:
    """(s, t, p): probability of a target word given a source word after ``rounds`` of expectation maximisation.

    Each round shares a target word of a verse among the verse's source words by their present probabilities, then normalises over
    source words. Both sums that a round needs, by verse and target word and by source and target word, stay within a target word. The
    pairs, as numbers, are therefore parted by target word once, and a round exchanges only the totals of source words: each task goes
    through the rounds so far over its own pairs, at most ``BLOCK`` of them, from the totals of the rounds before.

    Target words with more than ``BLOCK`` pairs, and all words where there are more than ``SOURCES`` source words, whose totals are then too
    many to send to each task, go through the same sums as window functions, which Spark exchanges and spills.
    """
    spark = pairs.sparkSession
    pairs = cut_lineage(pairs)
    s_names, t_names = (places(pairs.select(c).distinct(), [F.col(c)], f"{c}i") for c in "st")
    coded = cut_lineage(pairs.join(s_names, "s").join(t_names, "t").select("verse_id", "si", "ti", "n"))
    sizes = coded.groupBy("ti").agg(F.count("*").alias("size"))
    total, crowded_any = sizes.agg(F.sum("size"), F.max("size")).first()
    if not total:
        return pairs.select("s", "t", F.lit(1.0).alias("p")).limit(0)
    sources = s_names.count()
    by_hand = sources <= SOURCES
    crowded = sizes.where(F.col("size") > BLOCK).select("ti") if by_hand else sizes.select("ti")
    windowed = coded.join(crowded, "ti", "left_semi") if not by_hand or crowded_any > BLOCK else None
    local = None
    if by_hand:
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // BLOCK))
        local = coded if crowded_any <= BLOCK else coded.join(crowded, "ti", "left_anti")
        local = cut_lineage(local.repartition(n, "ti"))

    def by_task(overs: list[np.ndarray], last: bool):
        shared = spark.sparkContext.broadcast(overs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = [b for b in batches if b.num_rows]
            if not t:
                return
            verse, s, t, n = (c.to_numpy() for c in pa.Table.from_batches(t).columns)
            c, pair, st = _expected(verse, s, t, n, shared.value)
            if last:
                first = np.unique(pair, return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(s[first]), pa.array(t[first]), pa.array(st)], names=["si", "ti", "x"])
            else:
                own, at = np.unique(s, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(at.ravel(), c))], names=["si", "x"])

        return run

    sums = F.sum("p").over(Window.partitionBy("verse_id", "ti"))
    state = None if windowed is None else windowed.withColumn("p", F.lit(1.0))
    overs: list[np.ndarray] = []
    for k in range(rounds):
        parts = []
        if local is not None:
            parts.append(local.mapInArrow(by_task(overs, False), "si long, x double"))
        if state is not None:
            c = state.select("verse_id", "si", "ti", "n", (F.col("n") * F.col("p") / sums).alias("c"))
            state = cut_lineage(c.withColumn("st", F.sum("c").over(Window.partitionBy("si", "ti"))))
            parts.append(state.select("si", F.col("c").alias("x")))
        over = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        over = over.groupBy("si").agg(F.sum("x").alias("over"))
        if local is not None:
            got = over.toArrow()
            overs.append(np.ones(sources))
            overs[-1][got["si"].to_numpy()] = got["over"].to_numpy()
        if state is not None:
            over = cut_lineage(over)
            state = state.drop("c").join(over, "si").withColumn("p", F.col("st") / F.col("over"))
    found = [] if state is None else [state.select("si", "ti", "p").distinct()]
    if local is not None:
        last = spark.sparkContext.broadcast(overs[-1])
        share = F.pandas_udf(lambda i: pd.Series(last.value[i.to_numpy()]), "double")
        found.append(local.mapInArrow(by_task(overs[:-1], True), "si long, ti long, x double").select("si", "ti", (F.col("x") / share("si")).alias("p")))
    out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return cut_lineage(out.join(s_names, "si").join(t_names, "ti").select("s", "t", "p"))


def both_ways(forward: DataFrame, backward: DataFrame, support: DataFrame, least: float = 0.05, verses: int = 2) -> DataFrame:
    """(s, t, p, back, verses): pairs trusted both ways, each share at least ``least`` and together in at least ``verses`` verses."""
    b = backward.select(F.col("t").alias("s"), F.col("s").alias("t"), F.col("p").alias("back"))
    out = forward.join(b, ["s", "t"]).join(support, ["s", "t"])
    return out.where((F.col("s") != NULL) & (F.col("t") != NULL) & (F.col("p") >= least) & (F.col("back") >= least) & (F.col("verses") >= verses))


def best_source(trusted: DataFrame) -> DataFrame:
    """(t, s): for each target word the source word with the highest product of shares; of equals the first by code point."""
    return trusted.groupBy("t").agg(F.min(F.struct((-F.col("p") * F.col("back")).alias("k"), "s")).alias("b")).select("t", F.col("b.s").alias("s"))


def renderings(uses: DataFrame, least_root: int = 10, least: int = 3, other: str = "(other)") -> DataFrame:
    """(root, rendering, uses): counts of each rendering; those under ``least`` go together under ``other``; roots under ``least_root`` uses drop out."""
    n = uses.groupBy("root", "rendering").agg(F.count("*").alias("uses"))
    kept = n.groupBy("root").agg(F.sum("uses").alias("all")).where(F.col("all") >= least_root).select("root")
    return n.join(kept, "root").groupBy("root", F.when(F.col("uses") >= least, F.col("rendering")).otherwise(F.lit(other)).alias("rendering")).agg(F.sum("uses").alias("uses"))


def disagreement(uses: DataFrame) -> DataFrame:
    """(root, witnesses, disagreement): mean of one less the Jaccard likeness of the renderings of each two witnesses.

    Witnesses are few (books, versions), so a root's pairs of witnesses are bounded by their square.
    """
    sets = uses.select("witness", "root", "rendering").distinct()
    size = sets.groupBy("root", "witness").agg(F.count("*").alias("n"))
    a, b = sets.withColumnRenamed("witness", "wa"), sets.withColumnRenamed("witness", "wb")
    both = a.join(b, ["root", "rendering"]).where("wa < wb").groupBy("root", "wa", "wb").agg(F.count("*").alias("both"))
    x = size.select("root", F.col("witness").alias("wa"), F.col("n").alias("na")).join(size.select("root", F.col("witness").alias("wb"), F.col("n").alias("nb")), "root").where("wa < wb")
    j = x.join(both, ["root", "wa", "wb"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    out = j.groupBy("root").agg(F.avg(1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("disagreement"))
    return out.join(size.groupBy("root").agg(F.count("*").alias("witnesses")), "root")
