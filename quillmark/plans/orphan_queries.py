"""Orphan references of the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillmark.operators import orphans as O
from quillmark.sources.tables import table


def _book_key(c: str) -> Column:
    """A book as named: letter case, blanks around it and then one final full stop don't count."""
    return F.regexp_replace(F.lower(F.trim(F.col(c))), r"\.$", "")


def _state(spark: SparkSession, d: str) -> O.OrphanState:
    """The three kinds of reference and their parents, run through the state in the order of their times; keys bear the table they point at."""
    at = lambda name, key: F.concat(F.lit(f"{name} "), key.cast("string"))
    books = table(spark, d, "books")
    named = books.select(F.explode(F.array(F.lower("name"), F.lower("abbreviation"))).alias("book_key"), "added", "withdrawn")
    parents = (
        O.parent_records(table(spark, d, "verses"), at("verses", F.col("verse_id")), "loaded")
        .unionByName(O.parent_records(table(spark, d, "passages"), at("passages", F.col("passage_id")), "added", "withdrawn"))
        .unionByName(O.parent_records(named, at("books", F.col("book_key")), "added", "withdrawn"))
    )
    refs = (
        O.references(table(spark, d, "theme_verse"), "theme_verse", "id", at("verses", F.col("verse_id")), "loaded", F.col("verse_id"))
        .unionByName(O.references(table(spark, d, "passage_ranges"), "passage_ranges", "id", at("passages", F.col("passage_id")), "added", F.col("passage_id")))
        .unionByName(O.references(table(spark, d, "cross_references"), "cross_references", "id", at("books", _book_key("to_book")), "added", F.col("to_book")))
    )
    return O.fold(refs, parents)


def _month(df: DataFrame) -> DataFrame:
    return df.withColumn("period", F.date_format("period", "yyyy-MM"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return O.orphaned(_state(spark, d).log()).select("ref_table", "ref_id").distinct()


def p3_by_month(spark: SparkSession, d: str) -> DataFrame:
    return _month(O.orphans_by_period(O.orphaned(_state(spark, d).log())))


def p3_pending(spark: SparkSession, d: str) -> DataFrame:
    return _month(O.pending_by_period(_state(spark, d).log()))


_REFS_SQL = r"""
refs AS (
  SELECT DISTINCT 'theme_verse' AS ref_table, id AS ref_id, CAST(verse_id AS VARCHAR) AS key, loaded AS moment FROM theme_verse WHERE verse_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'passage_ranges', id, CAST(passage_id AS VARCHAR), added FROM passage_ranges WHERE passage_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'cross_references', id, regexp_replace(lower(trim(to_book)), '\.$', ''), added FROM cross_references
    WHERE to_book IS NOT NULL AND trim(to_book) <> ''
),
parents AS (
  SELECT 'theme_verse' AS ref_table, CAST(verse_id AS VARCHAR) AS key, min(loaded) AS since, CAST(NULL AS TIMESTAMP) AS until FROM verses WHERE verse_id IS NOT NULL GROUP BY verse_id
  UNION ALL SELECT DISTINCT 'passage_ranges', CAST(passage_id AS VARCHAR), added, withdrawn FROM passages
  UNION ALL SELECT DISTINCT 'cross_references', lower(name), added, withdrawn FROM books
  UNION ALL SELECT DISTINCT 'cross_references', lower(abbreviation), added, withdrawn FROM books
),
orphans AS (
  SELECT * FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.ref_table = r.ref_table AND p.key = r.key
      AND (r.moment IS NULL OR (p.since <= r.moment AND (p.until IS NULL OR r.moment < p.until))))
)
"""

QUERIES = {"p3_found": p3_found, "p3_by_month": p3_by_month, "p3_pending": p3_pending}

SQL = {
    "p3_found": f"WITH {_REFS_SQL} SELECT DISTINCT ref_table, ref_id FROM orphans",
    "p3_by_month": f"WITH {_REFS_SQL} SELECT ref_table, strftime(moment, '%Y-%m') AS period, count(*) AS orphans FROM orphans GROUP BY 1, 2",
    "p3_pending": f"""WITH {_REFS_SQL}, ch AS (
      SELECT ref_table, 'orphaned' AS change, moment FROM orphans WHERE moment IS NOT NULL
      UNION ALL SELECT r.ref_table, 'resolved', p.since FROM refs r JOIN (SELECT DISTINCT * FROM parents) p ON p.ref_table = r.ref_table AND p.key = r.key WHERE p.since > r.moment
      UNION ALL SELECT r.ref_table, 'reopened', p.until FROM refs r JOIN (SELECT DISTINCT * FROM parents) p ON p.ref_table = r.ref_table AND p.key = r.key WHERE p.until > r.moment),
    m AS (SELECT ref_table, strftime(moment, '%Y-%m') AS period, count(*) FILTER (change = 'orphaned') AS orphaned,
            count(*) FILTER (change = 'resolved') AS resolved, count(*) FILTER (change = 'reopened') AS reopened FROM ch GROUP BY 1, 2)
    SELECT *, CAST(sum(orphaned + reopened - resolved) OVER (PARTITION BY ref_table ORDER BY period) AS BIGINT) AS pending FROM m""",
}
