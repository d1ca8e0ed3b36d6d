"""Readers of the corpus's file formats, each to a DataFrame with a stated schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def translation_verses(texts: DataFrame, verses: DataFrame, books: DataFrame, translations: DataFrame, abbreviation: str) -> DataFrame:
    """Verses of one translation from the four source tables, with their canonical place."""
    chosen = translations.where(F.col("abbreviation") == abbreviation).select(F.col("id").alias("translation_id"))
    t = texts.join(chosen, "translation_id", "left_semi").select(F.col("verse_id").alias("vid"), "text")
    v = verses.select(F.col("id").alias("vid"), "book_id", "chapter", "verse_number")
    b = books.select(F.col("id").alias("book_id"), F.col("name").alias("book"), "order_index")
    return t.join(v, "vid").join(b, "book_id").select(F.col("vid").alias("verse_id"), "book", "order_index", "chapter", F.col("verse_number").alias("verse"), "text")


def tags_by_verse(tags: DataFrame) -> DataFrame:
    """(verse_id, tags): the tags of each verse in the order of their words."""
    s = F.struct(F.col("word_position").alias("stated"), F.col("strongs_number").alias("number"), F.col("morphology").alias("morph"))
    return tags.groupBy("verse_id").agg(F.sort_array(F.collect_list(s)).alias("tags"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A CSV lexicon with a header; of several rows of a number the last by all its columns."""
    df = spark.read.option("header", True).csv(path)
    rest = [c for c in df.columns if c != "number"]
    return df.where("number is not null").groupBy("number").agg(F.max(F.struct(*rest)).alias("r")).select("number", *(F.col(f"r.{c}").alias(c) for c in rest))


def reference_lines(spark: SparkSession, path: str) -> DataFrame:
    """Cross references of a text file: ``Gen.1.1<tab>Ps.8.3-Ps.8.5<tab>12``; comments and lines of another form drop out."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("p")).where("size(p) >= 3")
    end = r"^([1-3]?[A-Za-z]+)\.(\d+)\.(\d+)(?:-(?:[1-3]?[A-Za-z]+\.(\d+)\.)?(\d+))?$"
    cols = []
    for name, i in (("from", 0), ("to", 1)):
        at = lambda k, i=i: F.regexp_extract(F.get("p", F.lit(i)), end, k)
        number = lambda k, at=at: F.nullif(at(k), F.lit("")).cast("int")
        cols += [at(1).alias(f"{name}_book"), number(2).alias(f"{name}_chapter"), number(3).alias(f"{name}_verse_start"), F.coalesce(number(4), number(2)).alias(f"{name}_chapter_end"), F.coalesce(number(5), number(3)).alias(f"{name}_verse_end")]
    out = raw.select(*cols, F.get("p", F.lit(2)).try_cast("int").alias("votes"))
    return out.where("from_book <> '' and to_book <> '' and votes is not null")


def find_columns(columns: list[str], variants: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """For each wanted name the first column whose header, in letters alone, is one of its variants. KeyError where one is missing."""
    plain = {re.sub(r"[^a-z0-9]", "", c.lower()): c for c in reversed(columns)}
    out = {}
    for name, spellings in variants.items():
        hit = next((plain[s] for s in spellings if s in plain), None)
        if hit is None:
            raise KeyError(f"no column for {name} among {columns}")
        out[name] = hit
    return out


LINK_COLUMNS = {"source": ("citation1", "source", "from", "ref1"), "target": ("citation2", "target", "to", "ref2"), "kind": ("conectiontype", "connectiontype", "type", "kind")}


def citation_links(spark: SparkSession, glob: str, verse_books: list[str]) -> DataFrame:
    """(source, target, kind) of link files with headers of any spelling; rows with a verse of the named books at either end."""
    df = spark.read.option("header", True).csv(glob)
    c = find_columns(df.columns, LINK_COLUMNS)
    out = df.select(*(F.trim(F.col(f"`{c[k]}`")).alias(k) for k in LINK_COLUMNS))
    verse = "^(" + "|".join(map(re.escape, verse_books)) + r") \d+:\d+"
    return out.where(F.col("source").rlike(verse) | F.col("target").rlike(verse)).distinct()


def word_columns(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Column files of one text, ``id<tab>value`` each, zipped by word id; a missing value is null."""
    out = None
    for name, path in paths.items():
        one = spark.read.text(path).select(F.split("value", "\t").alias("p")).select(F.get("p", F.lit(0)).cast("long").alias("word_id"), F.get("p", F.lit(1)).alias(name)).where("word_id is not null")
        out = one if out is None else out.join(one, "word_id", "full")
    return out


def tagged_words(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``Gen.1.1#02=L<tab>word<tab>translit<tab>gloss<tab>numbers<tab>morphs`` as (code, chapter, verse, position, kind, surface, gloss, numbers, morphs).

    Numbers and morphs of a word of several parts stand in arrays; other lines drop out.
    """
    ref = r"^([1-3]?[A-Za-z]+)\.(\d+)\.(\d+)[^#]*#(\d+)=(\S+)"
    raw = spark.read.text(path).where(F.col("value").rlike(ref)).select(F.split("value", "\t").alias("p"))
    at = lambda i: F.regexp_extract(F.col("p")[0], ref, i)
    cell = lambda i: F.get("p", F.lit(i))
    return raw.select(at(1).alias("code"), at(2).cast("int").alias("chapter"), at(3).cast("int").alias("verse"), at(4).cast("int").alias("position"), at(5).alias("kind"), cell(1).alias("surface"), cell(3).alias("gloss"), F.split(F.coalesce(cell(4), F.lit("")), "/").alias("numbers"), F.split(F.coalesce(cell(5), F.lit("")), "/").alias("morphs"))


def word_elements(words: DataFrame) -> DataFrame:
    """One row for each part of a word (prefix, root, suffix), with its place in the word."""
    z = F.arrays_zip(F.col("numbers").alias("number"), F.col("morphs").alias("morph"))
    return words.select("code", "chapter", "verse", "position", "surface", F.posexplode(z).alias("part", "z")).select("code", "chapter", "verse", "position", "surface", "part", F.trim("z.number").alias("number"), F.trim("z.morph").alias("morph"))


def block_records(spark: SparkSession, path: str, start: str) -> DataFrame:
    """Lines of a block-structured file with their block: a line that matches ``start`` opens one. Such a file is a small rule book, ordered whole."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).where("text <> ''")
    w = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("line", "text", F.sum(F.col("text").rlike(start).cast("int")).over(w).alias("block")).where("block > 0")


def theme_file(spark: SparkSession, path: str) -> DataFrame:
    """A theme as JSON ``{"theme_id", "title", "verses": [{"reference", "role", "reason"}]}``, one row per verse."""
    schema = "theme_id string, title string, verses array<struct<reference: string, role: string, reason: string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("theme_id", "title", F.posexplode("verses").alias("at", "v")).select("theme_id", "title", "at", "v.*")


def theme_list(spark: SparkSession, path: str, theme_id: str) -> DataFrame:
    """A theme as plain lines ``reference | role | reason``; blank lines and comments drop out, a missing role is core."""
    p = spark.read.text(path).where("trim(value) <> '' and value not like '#%'").select(F.split("value", r"\s*\|\s*").alias("p"))
    part = lambda i: F.trim(F.get("p", F.lit(i)))
    return p.select(F.lit(theme_id).alias("theme_id"), part(0).alias("reference"), F.coalesce(F.nullif(part(1), F.lit("")), F.lit("core")).alias("role"), part(2).alias("reason"))


def resolved(lines: DataFrame, verses: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Theme lines with their verse_id, and those no verse is found for."""
    from quillmark.functions.text import reference
    from quillmark.operators.links import book_key

    r = lines.withColumn("r", reference("reference")).withColumn("key", book_key("r.book"))
    r = r.join(names.select("key", "book"), "key", "left").join(verses.select(F.col("book").alias("vb"), F.col("chapter").alias("vc"), F.col("verse").alias("vv"), "verse_id"), (F.col("book") == F.col("vb")) & (F.col("r.chapter") == F.col("vc")) & (F.col("r.verse_start") == F.col("vv")), "left")
    out = r.drop("r", "key", "vb", "vc", "vv")
    return out.where("verse_id is not null"), out.where("verse_id is null").drop("verse_id")
