"""Queries on the look and the encoding of texts: problems 2 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmark.llm.lookalike import bigram_counts, lookalike_pairs, one_form, united
from quillmark.llm.mojibake import find_garbled
from quillmark.sources.tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(field_name, key, text) of the three fields."""
    v = table(spark, d, "verses").select(F.lit("verses.text").alias("field_name"), F.col("verse_id").cast("string").alias("key"), "text")
    x = table(spark, d, "lexicon_forms").select(F.lit("lexicon_forms.script").alias("field_name"), F.col("strongs").alias("key"), F.col("script").alias("text"))
    c = table(spark, d, "lemma_corrections").select(F.lit("lemma_corrections.lemma").alias("field_name"), F.col("strongs").alias("key"), F.col("lemma").alias("text"))
    return v.unionByName(x).unionByName(c).where("key is not null and text is not null and text <> ''")


def _forms(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d)
    return one_form(rows, "text", bigram_counts(rows, "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    forms = _forms(spark, d)
    pairs = lookalike_pairs(forms.where("field_name <> 'lemma_corrections.lemma'"))
    script = forms.where("field_name = 'lexicon_forms.script'").select("key", "form", F.col("text").alias("script"))
    lemma = forms.where("field_name = 'lemma_corrections.lemma'").join(script, ["key", "form"]).where("text <> script")
    return pairs.unionByName(lemma.select("field_name", F.col("key").alias("key_a"), F.col("key").alias("key_b")).distinct())


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """The forms that unite different texts of one field, and the records they unite."""
    forms = _forms(spark, d)
    ids = united(forms).select("field_name", "form_id", "key").distinct()
    names = forms.select("field_name", F.unhex(F.md5("form")).alias("form_id"), "form").distinct()
    return ids.join(names, ["field_name", "form_id"]).select("field_name", "form", "key")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "documents"), "doc_id", "text").select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The documents concerned with their restored text; ``whole`` is false where something is lost."""
    return find_garbled(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p2_found": p2_found, "p2_forms": p2_forms, "p10_found": p10_found, "p10_restored": p10_restored}
SQL: dict[str, str] = {}
