"""References to records that do not exist, kept as keyed pending-orphan state.

A *parent* row says when a key is there: ``(key, pid, since, until)``, ``pid`` naming the record, ``until`` null while it is in use. A key is
present at ``t`` when some record of it has ``since <= t < until``; in a stream a record is there from an arrival to its next deletion,
and may arrive again. A *reference* is a row ``(ref_table, ref_id, key, at)``.

``OrphanState.step`` takes one batch of arrivals, deletions and references and gives what changes for references: ``orphaned`` at its own
time, ``resolved`` when a parent arrives later, ``reopened`` when it goes. A change that late news undoes comes out again with sign
-1, so the changes of all batches add up to one result however the rows are cut into batches. ``fold`` runs whole tables through it,
``pending_by_period`` makes snapshots of the log. ``probe`` tells the orphans of whole tables in one join, and checks it.

Defined results: a null or blank key refers to nothing and is never reported; a reference without a time is reported only when
its key is never present; a parent without ``since`` is never present, nor one whose ``until`` isn't later; equal copies of a row count
once; empty inputs give empty results. All joins are on the key with the reference side streamed, so a hot key is split by
adaptive skew handling; what is gathered for a key are its own parent records.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillmark.session import shared_dir

REFS = ["ref_table", "ref_id", "key", "at"]
PARENTS = ["key", "pid", "since", "until"]
CHANGES = [*REFS[:3], "change", "at"]


def references(df: DataFrame, ref_table: str, ref_id: str, key: Column, at: str, written: Column | None = None) -> DataFrame:
    """Rows of ``df`` as references; rows without a key drop out, copies count once. ``written`` is the key as it stands in the row, where ``key`` is a normal form of it."""
    w = (key if written is None else written).cast("string")
    out = df.where(w.isNotNull() & (F.trim(w) != "")).select(F.lit(ref_table).alias("ref_table"), F.col(ref_id).cast("long").alias("ref_id"), key.cast("string").alias("key"), F.col(at).alias("at"))
    return out.distinct()


def presence(df: DataFrame, key: Column, since: str, until: str | None = None) -> DataFrame:
    """Parent rows as disjoint presence intervals per key.

    Without ``until`` a key is present from its earliest ``since`` on, which is one partial aggregate. With it, overlapping
    intervals of a key (two names of one book, a row loaded twice) are merged by a window over that key's parents.
    """
    rows = df.select(key.cast("string").alias("key"), F.col(since).alias("since"), (F.col(until) if until else F.lit(None)).alias("until"))
    rows = rows.where(F.col("key").isNotNull() & F.col("since").isNotNull())
    if until is None:
        return rows.groupBy("key").agg(F.min("since").alias("since")).withColumn("until", F.lit(None).cast(rows.schema["since"].dataType))
    far = F.expr("timestamp_ntz'9999-12-31 00:00:00'")
    rows = rows.withColumn("end", F.coalesce("until", far)).where(F.col("since") < F.col("end")).select("key", "since", "end").distinct()
    w = Window.partitionBy("key").orderBy("since", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("first", F.when(before >= F.col("since"), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("first").over(w))
    out = rows.groupBy("key", "island").agg(F.min("since").alias("since"), F.max("end").alias("end"))
    return out.select("key", "since", F.when(F.col("end") < far, F.col("end")).alias("until"))


def probe(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The references whose key is not present at their own time."""
    p = parents.select(F.col("key").alias("p_key"), "since", "until")
    there = (F.col("key") == F.col("p_key")) & (F.col("at").isNull() | ((F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))))
    return refs.join(p, there, "left_anti")


def orphans_by_period(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Number of orphan references by table and period of their own time; rows without a time count under a null period."""
    return orphans.groupBy("ref_table", F.date_trunc(period, "at").cast("date").alias("period")).agg(F.count("*").alias("orphans"))


def pending_by_period(log: DataFrame, period: str = "month") -> DataFrame:
    """Snapshots at the end of each period with a change: opened, resolved, reopened, and references waiting then.

    The running total runs over the aggregated rows, one for each table and period, never over references. Changes without a
    time have no place on the line and are left out.
    """
    c = log.where("at is not null").groupBy("ref_table", F.date_trunc(period, "at").cast("date").alias("period")).agg(
        *(F.coalesce(F.sum(F.when(F.col("change") == k, F.col("sign"))), F.lit(0)).alias(k) for k in ("orphaned", "resolved", "reopened"))
    )
    w = Window.partitionBy("ref_table").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    c = c.where("orphaned <> 0 or resolved <> 0 or reopened <> 0")
    return c.withColumn("pending", F.sum(F.col("orphaned") + F.col("reopened") - F.col("resolved")).over(w))


def orphaned(log: DataFrame) -> DataFrame:
    """(ref_table, ref_id, key, at) of the references that were orphans at their own time, from the changes of all batches."""
    return log.where("change = 'orphaned'").groupBy(*REFS).agg(F.sum("sign").alias("n")).where("n > 0").drop("n")


def parent_records(df: DataFrame, key: Column, since: str, until: str | None = None) -> DataFrame:
    """Rows of ``df`` as parents. With ``until`` each distinct (key, since, until) is a record by itself; without, a key is one record, there from its earliest ``since`` on."""
    gone = F.col(until) if until else F.lit(None).cast(df.schema[since].dataType)
    rows = df.select(key.cast("string").alias("key"), F.col(since).alias("since"), gone.alias("until")).where("key is not null and since is not null")
    if until is None:
        return rows.groupBy("key").agg(F.min("since").alias("since"), F.min("until").alias("until")).select("key", F.lit("").alias("pid"), "since", "until")
    return rows.where("until is null or since < until").distinct().select("key", F.concat_ws("|", F.col("since").cast("string"), F.col("until").cast("string")).alias("pid"), "since", "until")


def _spans(events: Column) -> Column:
    """Events (pid, since, until) of one key as disjoint intervals in order: a record is there from an arrival to its next deletion."""
    arrivals = F.filter(events, lambda e: e["since"].isNotNull())
    gone = lambda a: F.array_min(F.transform(F.filter(events, lambda e: (e["pid"] == a["pid"]) & (e["until"] > a["since"])), lambda e: e["until"]))
    there = F.array_sort(F.transform(arrivals, lambda a: F.struct(a["since"].alias("since"), gone(a).alias("until"))))

    def put(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["since"].alias("since"), F.when(last["until"].isNotNull() & r["until"].isNotNull(), F.greatest(last["until"], r["until"])).alias("until"))
        meets = (F.size(done) > 0) & (last["until"].isNull() | (last["until"] >= r["since"]))
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(r)))

    return F.when(F.size(there) < 2, there).otherwise(F.aggregate(F.slice(there, 2, F.size(there)), F.slice(there, 1, 1), put))


def _index(events: DataFrame) -> DataFrame:
    """(k, before, after): the intervals of each key by the old events and by all."""
    e = F.struct("pid", "since", "until")
    lists = events.groupBy("key").agg(F.collect_list(F.when(F.col("old"), e)).alias("o"), F.collect_list(e).alias("n"))
    return lists.select(F.col("key").alias("k"), _spans(F.col("o")).alias("before"), _spans(F.col("n")).alias("after"))


def _timeline(spans: Column, at: Column) -> Column:
    """The one table of transitions: what happens to a reference of time ``at`` whose key is present in ``spans``."""
    present = F.exists(spans, lambda s: at.isNull() | ((s["since"] <= at) & (s["until"].isNull() | (at < s["until"]))))
    event = lambda k, t: F.struct(F.lit(k).alias("change"), t.alias("at"))
    later = F.flatten(F.transform(spans, lambda s: F.array(event("resolved", s["since"]), event("reopened", s["until"]))))
    later = F.filter(later, lambda e: e["at"] > at)
    return F.when(present, later).otherwise(F.concat(F.array(event("orphaned", at)), later))


@dataclass(frozen=True)
class OrphanState:
    """State between batches: parent records, references and changes, each a log under ``path`` to which a batch adds one folder.

    A batch writes only its own rows; it reads the parents of the keys it meets and the references of the keys whose parents it changes.
    ``path`` lies in a folder that all executors share. A batch that runs again overwrites its own folders, so nothing counts twice.
    """

    spark: SparkSession
    path: str
    batches: int = 0
    time: str = "timestamp_ntz"

    def _log(self, name: str, upto: int) -> DataFrame:
        schema = {
            "parents": f"key string, pid string, since {self.time}, until {self.time}",
            "refs": f"ref_table string, ref_id long, key string, at {self.time}",
            "changes": f"ref_table string, ref_id long, key string, change string, at {self.time}, sign long",
        }[name]
        if upto == 0:
            return self.spark.range(0).select(*(F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in schema.split(", ")))
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/{i}" for i in range(upto)))

    def step(self, refs: DataFrame | None = None, arrivals: DataFrame | None = None, deletions: DataFrame | None = None, again: bool = True) -> tuple[OrphanState, DataFrame]:
        """Apply one batch: arrivals ``(key, pid, since)``, deletions ``(key, pid, until)``, references; gives the next state and the changes.

        Rows without ``pid`` columns belong to one record for each key. With ``again`` references of earlier batches may come once more
        and count once; without, the caller vouches that they don't, which saves comparing with all of them.
        """
        k, none = self.batches, F.lit(None).cast(self.time)
        parts = []
        for df, since, until in ((arrivals, "since", None), (deletions, None, "until")):
            if df is not None:
                pid = F.col("pid") if "pid" in df.columns else F.lit("")
                parts.append(df.select("key", pid.alias("pid"), (F.col(since) if since else none).alias("since"), (F.col(until) if until else none).alias("until")).where("key is not null and coalesce(since, until) is not null"))
        news = self._log("parents", 0)
        for p in parts:
            news = news.unionByName(p)
        news.distinct().write.mode("overwrite").parquet(f"{self.path}/parents/{k}")
        fresh = self._log("refs", 0) if refs is None else refs.select(*REFS).where("key is not null").distinct()
        if again and k:
            held = self._log("refs", k).select(*(F.col(c).alias(f"h_{c}") for c in REFS))
            same = F.lit(True)
            for c in REFS:
                same = same & F.col(c).eqNullSafe(F.col(f"h_{c}"))
            fresh = fresh.join(held, same, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.path}/refs/{k}")
        now = replace(self, batches=k + 1)
        read = lambda name: self.spark.read.schema(now._log(name, 0).schema).parquet(f"{self.path}/{name}/{k}")
        fresh, news = read("refs"), read("parents")
        touched = news.select("key").distinct()
        asked = touched.unionByName(fresh.select("key")).distinct()
        records = self._log("parents", k).withColumn("old", F.lit(True)).unionByName(news.withColumn("old", F.lit(False))).join(asked, "key", "left_semi")
        index = _index(records)
        rows = fresh.withColumn("held", F.lit(False))
        if k:
            rows = rows.unionByName(self._log("refs", k).join(touched, "key", "left_semi").withColumn("held", F.lit(True)))
        rows = rows.join(index, F.col("key") == F.col("k"), "left")
        empty = F.array().cast(f"array<struct<since:{self.time},until:{self.time}>>")
        after = _timeline(F.coalesce("after", empty), F.col("at"))
        before = F.when(F.col("held"), _timeline(F.coalesce("before", empty), F.col("at"))).otherwise(F.array().cast(f"array<struct<change:string,at:{self.time}>>"))
        rows = rows.select(*REFS[:3], after.alias("a"), before.alias("b"))
        signed = lambda x, y, n: F.transform(F.array_except(x, y), lambda e: F.struct(e["change"].alias("change"), e["at"].alias("at"), F.lit(n).cast("long").alias("sign")))
        moved = rows.select(*REFS[:3], F.explode(F.concat(signed("a", "b", 1), signed("b", "a", -1))).alias("e")).select(*REFS[:3], "e.change", "e.at", "e.sign")
        moved.write.mode("overwrite").parquet(f"{self.path}/changes/{k}")
        return now, read("changes")

    def log(self) -> DataFrame:
        """The changes of all batches."""
        return self._log("changes", self.batches)

    def pending(self) -> DataFrame:
        """The references whose key is not present after all that is known."""
        index = _index(self._log("parents", self.batches).withColumn("old", F.lit(False)))
        live = index.where(F.exists("after", lambda x: x["until"].isNull())).select(F.col("k").alias("key"))
        return self._log("refs", self.batches).join(live, "key", "left_anti")


def fold(refs: DataFrame, parents: DataFrame, period: str = "month", most: int = 4) -> OrphanState:
    """Run references and parent records through ``OrphanState`` in the order of their times, and return the state after the last batch.

    A batch is one or more periods in a row; there are at most ``most`` batches, as each one reads the log of the earlier ones. Only the
    periods that occur reach the driver. Rows without a time come with the last batch.
    """
    spark = refs.sparkSession
    times = refs.select(F.col("at").alias("t")).unionByName(parents.select(F.col("since").alias("t"))).unionByName(parents.select(F.col("until").alias("t")))
    found = sorted(r["t"] for r in times.where("t is not null").groupBy(F.date_trunc(period, "t").alias("t")).agg(F.lit(1)).collect())
    kind = refs.schema["at"].dataType.simpleString()
    starts = [found[i * len(found) // min(most, len(found))] for i in range(min(most, len(found)))]
    state = OrphanState(spark, f"{shared_dir(spark)}/orphans-{uuid.uuid4().hex}", 0, kind)
    for i in range(max(1, len(starts))):
        low = F.lit(starts[i]).cast(kind) if i else None
        high = F.lit(starts[i + 1]).cast(kind) if i + 1 < len(starts) else None

        def within(df: DataFrame, c: str) -> DataFrame:
            if high is not None:
                return df.where((F.col(c) < high) if low is None else (F.col(c) >= low) & (F.col(c) < high))
            return df if low is None else df.where((F.col(c) >= low) | F.col(c).isNull())

        state, _ = state.step(within(refs, "at"), within(parents, "since").select("key", "pid", "since"), within(parents, "until").where("until is not null").select("key", "pid", "until"), again=False)
    return state
