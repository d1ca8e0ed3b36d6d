"""Queries on whole texts: problems 5, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmark.llm.bpe import encode
from quillmark.llm.packing import fill_containers
from quillmark.llm.spans import shared_share
from quillmark.sources.tables import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(table(spark, d, "documents"), "doc_id", "text").select("container", "doc_id", "piece")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers by how many tokens they hold."""
    held = fill_containers(table(spark, d, "documents"), "doc_id", "text").groupBy("container").agg(F.sum("size").alias("tokens"), F.count("*").alias("pieces"))
    return held.groupBy("tokens").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"))


_FIELDS = {"phrase_string": True, "text": False}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [shared_share(table(spark, d, "verses"), "verse_id", c, units).select(F.lit(c).alias("field_name"), F.col("id").alias("verse_id")) for c, units in _FIELDS.items()]
    return parts[0].unionByName(parts[1])


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each verse stands in a run that another verse holds too."""
    parts = [
        shared_share(table(spark, d, "verses"), "verse_id", c, units).select(F.lit(c).alias("field_name"), F.col("id").alias("verse_id"), "shared", "length", F.round("share", 6).alias("share"))
        for c, units in _FIELDS.items()
    ]
    return parts[0].unionByName(parts[1])


QUERIES = {"p5_found": p5_found, "p5_shares": p5_shares, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill}
_P5 = """WITH u AS (SELECT verse_id, list_filter(string_split(max(phrase_string), ' '), lambda x: x <> '') AS q FROM verses WHERE phrase_string IS NOT NULL GROUP BY verse_id),
c AS (SELECT verse_id, max(text) AS q FROM verses WHERE text IS NOT NULL GROUP BY verse_id),
k AS (SELECT verse_id, q, len(q) AS n, unnest(range(1, len(q) - 12 + 2)) AS i FROM u WHERE len(q) >= 12),
l AS (SELECT verse_id, q, length(q) AS n, unnest(range(1, length(q) - 70 + 2)) AS i FROM c WHERE length(q) >= 70),
g AS (SELECT 'phrase_string' AS field_name, verse_id, n, 12 AS w, i, array_to_string(list_slice(q, i, i + 11), chr(1)) AS x FROM k
  UNION ALL SELECT 'text', verse_id, n, 70, i, substr(q, i, 70) FROM l),
h AS (SELECT field_name, x FROM g GROUP BY 1, 2 HAVING count(DISTINCT verse_id) > 1),
f AS (SELECT g.* FROM g JOIN h USING (field_name, x))
"""

SQL: dict[str, str] = {
    "p5_found": f"{_P5} SELECT DISTINCT field_name, verse_id FROM f",
    "p5_shares": f"""{_P5}, t AS (SELECT field_name, verse_id, n, least(w, coalesce(lead(i) OVER (PARTITION BY field_name, verse_id ORDER BY i) - i, w)) AS step FROM f)
      SELECT field_name, verse_id, CAST(sum(step) AS BIGINT) AS shared, CAST(max(n) AS BIGINT) AS length, round(sum(step)::DOUBLE / max(n)::DOUBLE, 6) AS share FROM t GROUP BY 1, 2""",
}
