"""Command line: ``python -m quillmark COMMAND --data DIR ...``; tables come out as text, or as Parquet with ``--out``.

``ask`` answers a line of notation, ``build`` writes the facts that pages read, ``lift``, ``delta``, ``heat`` and ``sets`` show one operator
for a book or passage, ``results`` stores pages of a run and asks the store, ``query`` runs any registered query.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmark.plans import link_queries as K, mining_queries as W, notation, pages, registry, shelf_queries as S, style_queries as Y
from quillmark.plans.store import build_facts
from quillmark.session import local_session
from quillmark.sources.stores import ResultStore

Tables = dict[str, DataFrame]


def lift(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Words that a book, or a passage, has more or less of than its peers."""
    if a.passage:
        return {k: v for k, v in pages.passage_page(spark, a.data, a.passage, a.build).items() if k != "verses"} if a.absence else {"lift": pages.passage_page(spark, a.data, a.passage, a.build)["lift"]}
    if a.compare:
        return {"layers": Y.compare_layers(spark, a.data)}
    rows = Y.book_lift(spark, a.data).where(F.col("book") == a.book) if a.book else Y.book_lift(spark, a.data)
    return {"lift": rows.orderBy(F.desc("lift"), "book", "root")}


def delta(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Distance in manner between books, with the yardstick and what makes it."""
    d, detail = Y.delta(spark, a.data), Y.delta_detail(spark, a.data)
    if a.book:
        d, detail = d.where((F.col("book_a") == a.book) | (F.col("book_b") == a.book)), detail.where(F.col("book") == a.book)
    return {"delta": d.orderBy("delta", "book_a", "book_b"), "yardstick": Y.delta_yardstick(spark, a.data), "detail": detail}


def heat(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Windows of a book by a measure and a scale, and its spots."""
    scales: dict[str, Callable] = {"z": Y.strip_z, "percentile": Y.strip_percentile, "g2": Y.strip_g2, "count": Y.strips, "bell": Y.strip_bell}
    keep = lambda df: df.where(" and ".join(f"{c} = '{v}'" for c, v in (("book", (a.book or "").replace("'", "\\'")), ("measure", a.measure)) if v) or "true")
    return {"strip": keep(scales[a.scale](spark, a.data)).orderBy("book", "measure", "start"), "spots": keep(Y.spots(spark, a.data)).orderBy("book", "measure", "first")}


def sets(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Sets of words that travel together, where they stand, and their kinds."""
    return {"sets": W.constellations_all(spark, a.data).orderBy(F.desc("support"), "members"), "places": W.set_places_all(spark, a.data), "kinds": W.set_kinds(spark, a.data)}


def results(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Store pages, compare runs, ask a canned question or one's own."""
    store = ResultStore(spark, a.store)
    if a.line:
        run = a.run or store.begin(a.line[0])
        for line in a.line:
            store.write(run, line, {k: (df, df.columns) for k, df in pages.answer(spark, a.data, line, a.build).items()})
        return {"runs": store.runs()}
    if a.diff:
        return {"diff": store.diff(*a.diff)}
    if a.keep:
        store.keep(*a.keep)
        return {"runs": store.runs()}
    if a.sql:
        store.cells().createOrReplaceTempView("cells")
        return {"answer": notation.guarded_sql(spark, a.sql)}
    questions = {"shares": K.links_covered, "deltas": Y.nearest_books, "seams": registry.queries()["seam_check"], "listed": registry.queries()["citation_counts"], "idiom": S.echo_idiom}
    return {a.question: questions[a.question](spark, a.data)} if a.question else {"runs": store.runs()}


def query(spark: SparkSession, a: argparse.Namespace) -> Tables:
    return {a.name: registry.queries()[a.name](spark, a.data)}


def ask(spark: SparkSession, a: argparse.Namespace) -> Tables:
    return pages.answer(spark, a.data, a.line, a.build)


def build(spark: SparkSession, a: argparse.Namespace) -> Tables:
    path = build_facts(spark, a.data, a.to, a.label)
    return {"settings": spark.read.parquet(f"{path}/settings")}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(f: Callable, *options: tuple) -> None:
        c = sub.add_parser(f.__name__, help=f.__doc__)
        c.add_argument("--data", required=True, help="folder of the tables")
        c.add_argument("--build", help="folder of stored facts")
        c.add_argument("--out", help="write the tables as Parquet under this folder instead of showing them")
        c.add_argument("--rows", type=int, default=25, help="rows shown of each table")
        c.add_argument("--only", help="names of the tables to show, by commas")
        c.add_argument("--quiet", action="store_true", help="only the numbers of rows")
        for names, kw in options:
            c.add_argument(*names, **kw)
        c.set_defaults(do=f)

    flag = {"action": "store_true"}
    command(ask, (["line"], {}))
    command(build, (["to"], {}), (["--label"], {"default": "facts"}))
    command(lift, (["--book"], {}), (["--passage"], {}), (["--compare"], flag), (["--absence"], flag))
    command(delta, (["--book"], {}))
    command(heat, (["--book"], {}), (["--measure"], {"choices": ["density", "rare", "action"]}), (["--scale"], {"default": "z", "choices": ["z", "percentile", "g2", "count", "bell"]}))
    command(sets)
    command(results, (["--store"], {"required": True}), (["--line"], {"action": "append"}), (["--run"], {}), (["--diff"], {"nargs": 2}), (["--keep"], {"nargs": "+"}), (["--sql"], {}), (["--question"], {"choices": ["shares", "deltas", "seams", "listed", "idiom"]}))
    command(query, (["name"], {}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    tables = a.do(spark or SparkSession.getActiveSession() or local_session(), a)
    for name, df in tables.items():
        if a.only and name not in a.only.split(","):
            continue
        if a.out:
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
        elif a.quiet:
            print(name, df.count())
        else:
            print(f"\n{name}")
            df.show(a.rows, truncate=60)


if __name__ == "__main__":
    main()
