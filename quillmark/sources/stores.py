"""Writers: a build of fact tables, named copies, a store of results as cells, and parts replaced in place."""

from __future__ import annotations

import json
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillmark.operators.order import places


def checksum(df: DataFrame, *columns: str) -> str:
    """A digest of the rows, in whatever order they come: the sum over the rows' digests, with their number."""
    one = F.conv(F.substring(F.md5(F.to_json(F.struct(*columns))), 1, 12), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.sum(one).alias("s"), F.count("*").alias("n")).first()
    return f"{r['n']}:{r['s'] or 0}"


def write_build(tables: dict[str, DataFrame], root: str, label: str, settings: dict[str, object], by_book: tuple[str, ...] = (), jobs: int = 1) -> str:
    """Write a build under ``builds/<label>``: each table as Parquet, those of ``by_book`` partitioned by book, and the rules it was made by; ``jobs`` tables at a time.

    The settings are written last; a folder without them is no build, so a run that died leaves nothing that is read.
    """
    path = f"{root}/builds/{label}"
    spark = next(iter(tables.values())).sparkSession

    def write(name: str) -> None:
        w = tables[name].write.mode("overwrite")
        (w.partitionBy("book") if name in by_book else w).parquet(f"{path}/{name}")

    with ThreadPoolExecutor(jobs) as pool:
        list(pool.map(write, tables))
    rows = [(k, json.dumps(v, sort_keys=True, default=sorted)) for k, v in sorted(settings.items())]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    return path


def settings_of(spark: SparkSession, path: str) -> dict[str, object]:
    return {r["name"]: json.loads(r["value"]) for r in spark.read.parquet(f"{path}/settings").collect()}


def source_state(spark: SparkSession, path: str, *columns: str) -> dict[str, object]:
    """What is recorded of a source to tell later whether it changed: its files' bytes and last change, and, where ``columns`` are named, its checksum."""
    fs, p = _hadoop(spark, path)
    files = [s for s in _listed(fs, p) if not s[0].startswith(("_", "."))]
    out: dict[str, object] = {"bytes": sum(s[1] for s in files), "changed": max((s[2] for s in files), default=0)}
    return out | ({"checksum": checksum(spark.read.parquet(path), *columns)} if columns else {})


def is_stale(spark: SparkSession, path: str, **now: object) -> list[str]:
    """Names of the recorded settings, ``source_state`` among them if given, that differ from those of now.

    A state is the same where its checksums are equal, if both have one: a file written again with the same rows is no change.
    """
    was = settings_of(spark, path)

    def differs(a: object, b: object) -> bool:
        if isinstance(a, dict) and isinstance(b, dict) and "checksum" in a and "checksum" in b:
            return a["checksum"] != b["checksum"]
        return a != b

    return sorted(k for k, v in now.items() if differs(was.get(k), v))


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _listed(fs, p) -> list[tuple[str, int, int]]:
    """(name, bytes, change) of all files under a folder, on whatever file system."""
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        out.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
    return out


def subset(tables: dict[str, DataFrame], translations: list[str], out: str) -> None:
    """Copy a source: frame tables whole, texts of the named translations only.

    The copy is made beside its place, checked (every table reads back with the rows it was given), and only then moved there, so what lies
    under ``out`` is always whole.
    """
    ids = tables["translations"].where(F.col("abbreviation").isin(translations))
    spark = ids.sparkSession
    aside = f"{out}.{uuid.uuid4().hex}"
    for name, df in tables.items():
        if name == "translations":
            df = ids
        elif "translation_id" in df.columns:
            df = df.join(ids.select(F.col("id").alias("translation_id")), "translation_id", "left_semi")
        df.write.parquet(f"{aside}/{name}")
        if spark.read.parquet(f"{aside}/{name}").count() != df.count():
            raise RuntimeError(f"{name} does not read back with the rows it was given")
    fs, there = _hadoop(spark, out)
    fs.delete(there, True)
    if not fs.rename(_hadoop(spark, aside)[1], there):
        raise RuntimeError(f"could not move the copy to {out}")


def write_sets(sets: DataFrame, windows: DataFrame, path: str) -> None:
    """Word sets as three tables: ``sets`` (set_id, size, measures), ``members`` (set_id, place, root) and ``windows`` (set_id, ...), by a digest of the members.

    ``sets`` has the roots of each in ``members``, with blanks between; ``windows`` the same column and where the set stands.
    """
    key = F.xxhash64("members").alias("set_id")
    sets.select(key, *(c for c in sets.columns if c != "members")).write.mode("overwrite").parquet(f"{path}/sets")
    sets.select(key, F.posexplode(F.split("members", " ")).alias("place", "root")).write.mode("overwrite").parquet(f"{path}/members")
    windows.select(key, *(c for c in windows.columns if c != "members")).write.mode("overwrite").parquet(f"{path}/windows")


def replace_parts(df: DataFrame, path: str, *keys: str) -> None:
    """Write ``df``, replacing just the partitions of ``keys`` it has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def to_cells(df: DataFrame, page: str, section: str, order: list[str]) -> DataFrame:
    """A table as cells (page, section, row, column_index, column_name, value, number); ``order`` numbers the rows, from 1 on."""
    rows = places(df, [F.col(c) for c in order], "row").withColumn("row", (F.col("row") + 1).cast("int"))
    cols = F.array(*(F.struct(F.lit(i).alias("column_index"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(df.columns)))
    x = rows.select("row", F.explode(cols).alias("x"))
    return x.select(F.lit(page).alias("page"), F.lit(section).alias("section"), "row", "x.*", F.col("x.value").try_cast("double").alias("number"))


def from_cells(cells: DataFrame, columns: list[str]) -> DataFrame:
    """The table back from its cells, values as strings, in the order of its rows."""
    return cells.groupBy("row").pivot("column_name", columns).agg(F.first("value")).orderBy("row").drop("row")


class ResultStore:
    """Results of runs as cells, partitioned by run; writing a page of a run again replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def begin(self, label: str) -> str:
        run = f"{time.strftime('%Y%m%d%H%M%S')}-{re.sub(r'[^A-Za-z0-9]+', '-', label)}"
        return run

    def write(self, run_id: str, page: str, sections: dict[str, tuple[DataFrame, list[str]]]) -> None:
        parts = [to_cells(df, page, name, order) for name, (df, order) in sections.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        replace_parts(out.withColumn("run_id", F.lit(run_id)).withColumn("page_key", F.lit(re.sub(r"[^A-Za-z0-9]+", "-", page))), f"{self.path}/cells", "run_id", "page_key")

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def runs(self) -> DataFrame:
        return self.cells().groupBy("run_id").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("cells"))

    def section(self, run_id: str, page: str, section: str) -> DataFrame:
        c = self.cells().where((F.col("run_id") == run_id) & (F.col("page") == page) & (F.col("section") == section))
        names = [r["column_name"] for r in c.select("column_index", "column_name").distinct().orderBy("column_index").collect()]
        return from_cells(c, names)

    def diff(self, a: str, b: str) -> DataFrame:
        """(page, section, row, column_name, before, after, change): cells that differ between two runs, or stand in one alone."""
        keys = ["page", "section", "row", "column_name"]
        x = self.cells().where(F.col("run_id") == a).select(*keys, F.col("value").alias("before"), F.lit(True).alias("in_a"))
        y = self.cells().where(F.col("run_id") == b).select(*keys, F.col("value").alias("after"), F.lit(True).alias("in_b"))
        j = x.join(y, keys, "full").where("in_a is null or in_b is null or not (before <=> after)")
        return j.select(*keys, "before", "after", F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "dropped").otherwise("changed").alias("change"))

    def keep(self, *run_ids: str) -> None:
        """Drop all other runs' partitions."""
        for r in self.runs().select("run_id").collect():
            if r["run_id"] not in run_ids:
                self._delete(f"{self.path}/cells/run_id={r['run_id']}")

    def _delete(self, path: str) -> None:
        fs, p = _hadoop(self.spark, path)
        fs.delete(p, True)


def pack(spark: SparkSession, path: str, out: str, run_id: str | None = None) -> None:
    """Copy the tables of a folder, of one run if named, as one compressed file each, to hand on; for results small enough for that."""
    fs, p = _hadoop(spark, path)
    for f in fs.listStatus(p):
        if f.isDirectory():
            name = f.getPath().getName()
            df = spark.read.parquet(f"{path}/{name}")
            if run_id is not None and "run_id" in df.columns:
                df = df.where(F.col("run_id") == run_id)
            df.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}")


def dump(df: DataFrame, path: str, order: list[str]) -> None:
    """A small table as ordered JSON lines, the same bytes for the same rows; its schema lies beside them."""
    df.repartitionByRange(1, *order).sortWithinPartitions(*order).write.mode("overwrite").json(path)
    df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{path}.schema")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The table back from its dump, in the types it had."""
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}.schema").first()["value"]))
    return spark.read.schema(schema).json(path)


def write_references(refs: DataFrame, path: str) -> None:
    """Cross references as the text lines that ``files.reference_lines`` reads: ``Gen.1.1<tab>Ps.8.3-Ps.8.5<tab>12``."""
    at = lambda e, c, v: F.concat_ws(".", f"{e}_book", F.col(c).cast("string"), F.col(v).cast("string"))

    def end(e: str) -> Column:
        single = (F.col(f"{e}_chapter") == F.col(f"{e}_chapter_end")) & (F.col(f"{e}_verse_start") == F.col(f"{e}_verse_end"))
        first = at(e, f"{e}_chapter", f"{e}_verse_start")
        return F.when(single, first).otherwise(F.concat_ws("-", first, at(e, f"{e}_chapter_end", f"{e}_verse_end")))

    refs.select(F.concat_ws("\t", end("from"), end("to"), F.col("votes").cast("string")).alias("value")).write.mode("overwrite").text(path)


def text_table(df: DataFrame, limit: int = 40) -> str:
    """The first rows as aligned text: numbers to the right, others to the left."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.limit(limit).collect()]
    width = [max(len(x) for x in col) for col in zip(df.columns, *rows)]
    right = [t in ("int", "bigint", "double", "float", "decimal") for _, t in df.dtypes]
    line = lambda r: "  ".join(x.rjust(w) if k else x.ljust(w) for x, w, k in zip(r, width, right)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in width]), *map(line, rows)])


def term_counts(content: DataFrame) -> DataFrame:
    """(verse_id, counts): each verse's words as a map, the sparse form that models read."""
    n = content.groupBy("verse_id", "root").agg(F.count("*").alias("n"))
    return n.groupBy("verse_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("root", "n")))).alias("counts"))
