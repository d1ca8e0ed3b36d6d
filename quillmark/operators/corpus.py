"""The base layer: verses, books and word occurrences with copies taken once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmark.sources.tables import table

ROOT = r"^[HG]\d+$"
_PREPARED: dict[str, str] = {}


@contextmanager
def prepared(d: str, build: str) -> Iterator[None]:
    """Within, what is made of the tables of ``d`` starts from the verses and words that ``build`` holds, with copies taken once and places joined."""
    _PREPARED[d] = build
    try:
        yield
    finally:
        del _PREPARED[d]


def _read(spark: SparkSession, d: str, name: str) -> DataFrame | None:
    return spark.read.parquet(f"{_PREPARED[d]}/{name}").withColumn("book", F.col("book").cast("string")) if d in _PREPARED else None


def verses(spark: SparkSession, d: str) -> DataFrame:
    """One row per verse_id; of copies the least value of each column, the earliest load."""
    if (held := _read(spark, d, "verses")) is not None:
        return held.select("verse_id", "book", "chapter", "verse", "language")
    v = table(spark, d, "verses").where("verse_id is not null")
    return v.groupBy("verse_id").agg(*(F.min(c).alias(c) for c in ("book", "chapter", "verse", "language")))


def verse_texts(spark: SparkSession, d: str) -> DataFrame:
    if (held := _read(spark, d, "verses")) is not None:
        return held
    v = table(spark, d, "verses").where("verse_id is not null")
    return v.groupBy("verse_id").agg(*(F.min(c).alias(c) for c in ("book", "chapter", "verse", "text", "word_string", "phrase_string", "language")))


def books(spark: SparkSession, d: str) -> DataFrame:
    """One row per book name, with its number, testament and baseline group. A reference table: it doesn't grow with the text."""
    b = table(spark, d, "books").where("name is not null").groupBy(F.col("name").alias("book"))
    return b.agg(F.min("book_num").alias("book_num"), F.min("testament").alias("testament"), F.min("baseline_group").alias("baseline_group"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Word occurrences: one row for each (verse_id, position), combined before the shuffle, with the place of its verse."""
    if (held := _read(spark, d, "words")) is not None:
        return held
    t = table(spark, d, "tokens").where("verse_id is not null and position is not null").groupBy("verse_id", "position")
    t = t.agg(*(F.min(c).alias(c) for c in ("surface", "lemma", "root", "strongs", "morph")), F.coalesce(F.bool_or("is_stop"), F.lit(False)).alias("is_stop"))
    return t.join(verses(spark, d).where("book is not null"), "verse_id")


def content(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences that count as content: with a root and not a stop word."""
    return tokens(spark, d).where("root is not null and not is_stop")


def units(spark: SparkSession, d: str) -> DataFrame:
    """Verses with their words and units as arrays."""
    v = verse_texts(spark, d).where("book is not null and phrase_string is not null")
    split = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    return v.select("verse_id", "book", "chapter", "verse", "language", split("phrase_string").alias("units"), split("word_string").alias("words"))


#: The same layer as SQL, to be put before a query.
SQL = """
vb AS (SELECT verse_id, min(book) AS book, min(chapter) AS chapter, min(verse) AS verse, min(language) AS language FROM verses WHERE verse_id IS NOT NULL GROUP BY 1),
vt AS (SELECT verse_id, min(book) AS book, min(chapter) AS chapter, min(verse) AS verse, min(language) AS language, min(text) AS text, min(word_string) AS word_string, min(phrase_string) AS phrase_string FROM verses WHERE verse_id IS NOT NULL GROUP BY 1),
bk AS (SELECT name AS book, min(book_num) AS book_num, min(testament) AS testament, min(baseline_group) AS baseline_group FROM books WHERE name IS NOT NULL GROUP BY 1),
tk AS (SELECT t.*, vb.book, vb.chapter, vb.verse, vb.language FROM (
  SELECT verse_id, position, min(surface) AS surface, min(lemma) AS lemma, min(root) AS root, min(strongs) AS strongs, min(morph) AS morph, coalesce(bool_or(is_stop), false) AS is_stop
  FROM tokens WHERE verse_id IS NOT NULL AND position IS NOT NULL GROUP BY 1, 2) t JOIN vb USING (verse_id) WHERE vb.book IS NOT NULL),
ct AS (SELECT * FROM tk WHERE root IS NOT NULL AND NOT is_stop),
un AS (SELECT verse_id, book, chapter, verse, language, list_filter(string_split(phrase_string, ' '), lambda x: x <> '') AS units, list_filter(string_split(word_string, ' '), lambda x: x <> '') AS words
  FROM vt WHERE book IS NOT NULL AND phrase_string IS NOT NULL)
"""
