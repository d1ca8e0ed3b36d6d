"""How distinctive a term is for a record: smoothed language-model divergence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def distinctive_terms(counts: DataFrame, record: str, term: str, n: str = "n", mu: float = 2000.0, min_df: int = 2) -> DataFrame:
    """Contribution of each term to the relative entropy between its record and the collection.

    ``counts`` has rows (record, term, n); rows of one (record, term) are added up. With p_C = c / T and the Dirichlet-smoothed
    p_d = (n + mu * p_C) / (t + mu), the score is p_d * ln(p_d / p_C): common terms count little, terms that mark the record
    count much, terms rarer here than elsewhere come out below zero. ``min_df`` drops terms in fewer records.

    Out come record, term, ``n``, ``record_total`` (t), ``term_total`` (c), ``total`` (T), ``df`` and ``score``.

    Rows with a null record or term, or without a positive count, take no part; an empty input gives an empty result; equal
    scores are all kept, in no order. Two joins on aggregated counts: the term totals and the record totals are far smaller than the
    occurrences, and a hot term or record is one row of them.
    """
    r, w = F.col(record), F.col(term)
    base = counts.where(r.isNotNull() & w.isNotNull() & (F.col(n) > 0)).groupBy(r.alias("record"), w.alias("term")).agg(F.sum(n).cast("long").alias("n"))
    terms = base.groupBy("term").agg(F.sum("n").alias("term_total"), F.count("*").alias("df")).where(F.col("df") >= min_df)
    records = base.groupBy("record").agg(F.sum("n").alias("record_total"))
    total = base.agg(F.sum("n")).scalar()
    p_c = F.col("term_total") / F.col("total")
    p_d = (F.col("n") + F.lit(float(mu)) * p_c) / (F.col("record_total") + F.lit(float(mu)))
    out = base.join(terms, "term").join(records, "record").withColumn("total", total)
    out = out.withColumn("score", p_d * F.log(p_d / p_c))
    return out.select(F.col("record").alias(record), F.col("term").alias(term), "n", "record_total", "term_total", "total", "df", "score")
