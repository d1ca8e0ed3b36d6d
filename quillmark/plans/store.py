"""Facts of a text written once and read by the pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmark.operators import corpus as C
from quillmark.plans import fact_queries as X, link_queries as K, mining_queries as W, more_queries as N, shelf_queries as S, style_queries as Y, text_queries as T
from quillmark.sources.stores import write_build

Query = Callable[[SparkSession, str], DataFrame]


#: What the pages read, by name.
FACTS: dict[str, Query] = {
    f.__name__: f
    for f in (
        X.weight_scales, X.common_form, X.pull, X.shadow, X.book_totals, X.signature_words, X.word_book, X.word_chapter, X.formulas, X.echo_places, X.echo_partners,
        K.synopsis, K.kin_ordered, K.shared_vocabulary, K.compare_chapters, K.parallel_runs, K.link_votes, K.passage_verses, K.theme_roles, K.theme_strip,
        W.renderings, Y.group_keyness, Y.function_profile, Y.richness, Y.reach_depth, Y.section_words, Y.nearest_books, Y.spots, Y.book_lift, Y.chapter_strip, Y.delta, Y.dice_books, Y.leaning_words, Y.passage_lift, Y.passage_absence,
        T.home_words, T.parts_of_speech, T.verb_table, N.lexicon_display, S.root_verses, S.folded_signatures,
    )
}
_SORTED = ("root", "focus", "verse_a", "from_verse", "passage_id", "theme_id", "phrase")


def build_facts(spark: SparkSession, d: str, root: str, label: str = "facts", names: list[str] | None = None, jobs: int = 4) -> str:
    """Write the facts of the tables in ``d`` as a build, and return its folder.

    Tables with a book are partitioned by it, the others sorted by what pages look them up by, so that a page reads the files and row groups it is about.
    The verses and the placed words are written first and the other facts made from them, ``jobs`` at a time.
    """
    base = {"verses": C.verse_texts(spark, d), "words": C.tokens(spark, d)}
    path = write_build(base, root, label, {"source": d}, tuple(base))
    tables = {}
    with C.prepared(d, path):
        for name in names or list(FACTS):
            df = FACTS[name](spark, d)
            if "book" in df.columns:
                df = df.hint("rebalance", F.col("book"))  # a book with most of the rows is split over tasks
            elif keys := [c for c in _SORTED if c in df.columns]:
                df = df.repartitionByRange(keys[0]).sortWithinPartitions(keys[0])
            tables[name] = df
        return write_build(tables, root, label, {"tables": sorted({*tables, *base}), "source": d}, tuple(n for n, df in tables.items() if "book" in df.columns), jobs)


class Facts:
    """The facts by name: read from a build where one is given, otherwise made from the tables."""

    def __init__(self, spark: SparkSession, d: str, build: str | None = None):
        self.spark, self.d, self.build = spark, d, build

    def __call__(self, name: str) -> DataFrame:
        if self.build is None:
            return {"verses": C.verse_texts, "words": C.tokens, **FACTS}[name](self.spark, self.d)
        df = self.spark.read.parquet(f"{self.build}/{name}")
        return df.withColumn("book", F.col("book").cast("string")) if "book" in df.columns else df
