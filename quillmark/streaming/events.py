"""Streaming forms: windows over events, and orphan references batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.operators.orphans import OrphanState


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; a window closes when the watermark passes it, and rows later than that are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sliding(events: DataFrame, length: str = "10 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, by its id, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def track_orphans(stream: DataFrame, path: str, checkpoint: str, seen: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Keep orphan state over a stream of rows (kind, ref_table, ref_id, key, at), kind being ``ref``, ``arrival`` or ``deletion``.

    Each batch adds its own folder to the logs under ``path``; a batch that runs again writes the same folder, so nothing counts
    twice. ``seen`` gets the batch's changes.
    """

    def step(df: DataFrame, batch: int) -> None:
        df = df.persist()
        pick = lambda kind, t: df.where(F.col("kind") == kind).select("key", F.col("at").alias(t))
        state = OrphanState(df.sparkSession, path, batch, df.schema["at"].dataType.simpleString())
        _, changes = state.step(df.where("kind = 'ref'").select("ref_table", "ref_id", "key", "at"), pick("arrival", "since"), pick("deletion", "until"))
        if seen:
            seen(batch, changes)
        df.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
