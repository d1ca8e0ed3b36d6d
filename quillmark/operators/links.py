"""Cross references, passages and themes as ranges over verses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def book_names(books: DataFrame) -> DataFrame:
    """(key, book, book_num): each book by its name and its abbreviation in lower case; a reference table."""
    rows = books.where("name is not null").select("name", "book_num", F.explode(F.array(F.lower("name"), F.lower("abbreviation"))).alias("key")).where("key is not null")
    return rows.groupBy("key").agg(F.min("name").alias("book"), F.min("book_num").alias("book_num"))


def book_key(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c if isinstance(c, Column) else F.col(c))), r"\.$", "")


def in_ranges(ranges: DataFrame, verses: DataFrame) -> DataFrame:
    """Rows of ``ranges`` (book, chapter_start, verse_start, chapter_end, verse_end, ...) with each verse_id they cover.

    Joined on book and chapter, since a range spans few chapters, and then on the verse; a null end is the start.
    """
    last = F.coalesce("chapter_end", "chapter_start")
    r = ranges.where("book is not null and chapter_start is not null and verse_start is not null")
    r = r.withColumn("to_c", F.greatest(last, "chapter_start")).withColumn("to_v", F.coalesce("verse_end", F.when(last == F.col("chapter_start"), F.col("verse_start"))))
    r = r.withColumn("chapter", F.explode(F.sequence("chapter_start", "to_c")))
    v = verses.select("book", "chapter", "verse", "verse_id")
    inside = ((F.col("chapter") > F.col("chapter_start")) | (F.col("verse") >= F.col("verse_start"))) & ((F.col("chapter") < F.col("to_c")) | F.col("to_v").isNull() | (F.col("verse") <= F.col("to_v")))
    return r.join(v, ["book", "chapter"]).where(inside).drop("to_c", "to_v")


def link_ends(refs: DataFrame, names: DataFrame, end: str) -> DataFrame:
    """(id, book, chapter_start, ...) of one end of the cross references, books resolved by name or abbreviation."""
    r = refs.select("id", book_key(f"{end}_book").alias("key"), F.col(f"{end}_chapter").alias("chapter_start"), F.col(f"{end}_verse_start").alias("verse_start"), F.col(f"{end}_chapter").alias("chapter_end"), F.col(f"{end}_verse_end").alias("verse_end")).distinct()
    return r.join(names, "key").drop("key", "book_num")


def link_votes(refs: DataFrame, names: DataFrame, verses: DataFrame) -> DataFrame:
    """(from_verse, to_verse, votes): the best score of a link whose two ranges cover the two verses."""
    a = in_ranges(link_ends(refs, names, "from"), verses).select("id", F.col("verse_id").alias("from_verse"))
    b = in_ranges(link_ends(refs, names, "to"), verses).select("id", F.col("verse_id").alias("to_verse"))
    score = refs.groupBy("id").agg(F.max("relevance_score").alias("score"))
    return a.join(b, "id").join(score, "id").groupBy("from_verse", "to_verse").agg(F.max("score").alias("votes"))
