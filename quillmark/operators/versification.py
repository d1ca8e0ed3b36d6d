"""Numbering of verses: maps between traditions, the tests that choose among them, and divisions of books."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def renumbered(verses: DataFrame, verse_map: DataFrame, chapter_map: DataFrame | None = None) -> DataFrame:
    """Verses with ``to_chapter`` and ``to_verse``: by the verse map, else by the chapter map, else unchanged. ``mapped`` names which."""
    v = verse_map.select("book", "chapter", "verse", F.col("to_chapter").alias("vc"), F.col("to_verse").alias("vv"))
    out = verses.join(v, ["book", "chapter", "verse"], "left")
    c = chapter_map.select("book", "chapter", F.col("to_chapter").alias("cc")) if chapter_map is not None else None
    out = out.join(c, ["book", "chapter"], "left") if c is not None else out.withColumn("cc", F.lit(None).cast("int"))
    how = F.when(F.col("vc").isNotNull(), "verse").when(F.col("cc").isNotNull(), "chapter").otherwise("same")
    return out.withColumn("mapped", how).withColumn("to_chapter", F.coalesce("vc", "cc", "chapter")).withColumn("to_verse", F.coalesce("vv", "verse")).drop("vc", "vv", "cc")


def joined_texts(renumbered_: DataFrame) -> DataFrame:
    """Texts at their new numbers; verses that fall together are joined in the order of their old numbers."""
    t = F.sort_array(F.collect_list(F.struct("chapter", "verse", "text")))
    return renumbered_.groupBy("book", F.col("to_chapter").alias("chapter"), F.col("to_verse").alias("verse")).agg(F.array_join(F.transform(t, lambda x: x["text"]), " ").alias("text"))


_TEST = re.compile(r"^\s*(\w+)\.(\d+):(\d+)\s*(=Exist|=NotExist|=Last|[<>]\s*(\w+)\.(\d+):(\d+)(?:\*(\d+))?)\s*$")


def holds(test: str, lengths: dict[tuple[str, int, int], int]) -> bool:
    """Whether every part of a test holds: ``Gen.1:5=Exist``, ``=NotExist``, ``=Last`` (of its chapter), or lengths compared, ``Gen.1:5 < Gen.1:6*2``; parts are joined by ``&``."""
    for part in test.split("&"):
        m = _TEST.match(part)
        if not m:
            raise ValueError(f"not a test: {part!r}")
        key = (m[1], int(m[2]), int(m[3]))
        if m[4].startswith("="):
            there = key in lengths
            ok = {"=Exist": there, "=NotExist": not there, "=Last": there and key[2] == max(v for b, c, v in lengths if (b, c) == key[:2])}[m[4]]
        else:
            other = (m[5], int(m[6]), int(m[7]))
            x, y = lengths.get(key), lengths.get(other)
            ok = x is not None and y is not None and (x < y * int(m[8] or 1) if m[4][0] == "<" else x > y * int(m[8] or 1))
        if not ok:
            return False
    return True


def best_column(scored: DataFrame) -> DataFrame:
    """(record, column_name): the numbering of each record with the best score; of equals the first by name."""
    return scored.groupBy("record").agg(F.min(F.struct((-F.col("score")).alias("s"), "column_name")).alias("b")).select("record", F.col("b.column_name").alias("column_name"))


def map_check(verse_map: DataFrame, verses: DataFrame) -> DataFrame:
    """(book, mapped, missing): how many targets of a map are verses of the text."""
    v = verses.select("book", F.col("chapter").alias("to_chapter"), F.col("verse").alias("to_verse"), F.lit(True).alias("there")).distinct()
    return verse_map.join(v, ["book", "to_chapter", "to_verse"], "left").groupBy("book").agg(F.count("*").alias("mapped"), F.count_if(F.col("there").isNull()).alias("missing"))


def sections(chapters: DataFrame, divisions: DataFrame) -> DataFrame:
    """(book, chapter, section): each chapter's section by its range (book, section, first, last), else ``Rest of <book>``."""
    d = divisions.select(F.col("book").alias("b"), "section", "first", "last")
    out = chapters.join(d, (F.col("book") == F.col("b")) & F.col("chapter").between(F.col("first"), F.col("last")), "left")
    return out.select("book", "chapter", F.coalesce("section", F.concat(F.lit("Rest of "), F.col("book"))).alias("section"))


def seams(sectioned: DataFrame) -> DataFrame:
    """(book, section, first, last): where sections begin and end."""
    return sectioned.groupBy("book", "section").agg(F.min("chapter").alias("first"), F.max("chapter").alias("last"))


def closest_family(pairs: DataFrame, gap: float) -> DataFrame:
    """(member, family): single-link groups of pairs (a, b, distance) no further apart than ``gap``; a family bears its least member.

    Labels spread along links until none changes, one join a round; the links are of translations or books, few by nature.
    """
    from quillmark.session import cut_lineage

    links = pairs.where(F.col("distance") <= gap)
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = pairs.select(F.col("a").alias("member")).unionByName(pairs.select(F.col("b").alias("member"))).distinct()
    label = cut_lineage(nodes.withColumn("family", F.col("member")))
    while True:
        near = both.join(label, both["b"] == label["member"]).groupBy("a").agg(F.min("family").alias("f"))
        nxt = cut_lineage(label.join(near, label["member"] == near["a"], "left").select("member", F.least("family", F.coalesce("f", "family")).alias("family")))
        if nxt.join(label.select("member", F.col("family").alias("was")), "member").where("family <> was").isEmpty():
            return nxt
        label = nxt


def root_families(links: DataFrame, names: list[str] = (), steps: int = 8) -> DataFrame:
    """(root, family): the root reached by following ``parent`` links, at most ``steps`` times; a name is never gone through."""
    l = links.where(F.col("parent").isNotNull() & ~F.col("parent").isin(*names, "")).select(F.col("root").alias("child"), "parent")
    out = links.select("root").distinct().withColumn("family", F.col("root"))
    for _ in range(steps):
        out = out.join(l, out["family"] == l["child"], "left").select("root", F.coalesce("parent", "family").alias("family"))
    return out


def local_peaks(values: DataFrame, by: str, at: str, value: str, apart: int) -> DataFrame:
    """Rows that are the greatest within ``apart`` places to either side; of equals the first."""
    w = Window.partitionBy(by).orderBy(at).rangeBetween(-apart, apart)
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(at)).alias("p"))).over(w)
    return values.withColumn("best", best).where((F.col("best.v") == F.col(value)) & (-F.col("best.p") == F.col(at))).drop("best")
