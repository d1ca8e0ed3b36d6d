"""Readers, stores, notation, pages and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillmark.plans import notation as N, pages as P
from quillmark.plans.store import build_facts
from quillmark.sources import files as S, stores as W
from quillmark.streaming import events as V

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_translation_verses(spark):
    t = {
        "books": spark.createDataFrame([(1, "One", 1)], "id int, name string, order_index int"), "translations": spark.createDataFrame([(1, "AAA"), (2, "BBB")], "id int, abbreviation string"),
        "verses": spark.createDataFrame([(10, 1, 1, 1), (11, 1, 1, 2)], "id int, book_id int, chapter int, verse_number int"), "verse_texts": spark.createDataFrame([(10, 1, "a"), (11, 1, "b"), (10, 2, "c")], "verse_id int, translation_id int, text string"),
    }
    got = S.translation_verses(t["verse_texts"], t["verses"], t["books"], t["translations"], "AAA")
    assert {(r["verse_id"], r["book"], r["verse"], r["text"]) for r in got.collect()} == {(10, "One", 1, "a"), (11, "One", 2, "b")}


def test_subset_and_build(spark, tmp_path):
    tables = {"translations": spark.createDataFrame([(1, "AAA"), (2, "BBB")], "id int, abbreviation string"), "verse_texts": spark.createDataFrame([(10, 1), (10, 2)], "verse_id int, translation_id int")}
    W.subset(tables, ["AAA"], str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/verse_texts")).count() == 1
    path = W.write_build({"words": spark.createDataFrame([("B", "r")], "book string, root string")}, str(tmp_path), "first", {"window": 5, "lengths": [2, 3]}, ("words",))
    assert W.settings_of(spark, path) == {"window": 5, "lengths": [2, 3]} and W.is_stale(spark, path, window=5) == [] and W.is_stale(spark, path, window=6, other=1) == ["other", "window"]
    assert spark.read.parquet(f"{path}/words").where("book = 'B'").count() == 1
    W.pack(spark, path, str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed/words")).count() == 1


def test_checksum_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    assert W.checksum(a, "id", "t") == W.checksum(a.orderBy(F.desc("id")).repartition(3), "id", "t") != W.checksum(a.limit(1), "id", "t")


def test_text_formats(spark, tmp_path):
    lex = put(tmp_path / "l.csv", "number,word,gloss\nH1,av,father\nH1,av,a father\nH2,em,mother\n")
    assert {(r["number"], r["gloss"]) for r in S.lexicon(spark, lex).collect()} == {("H1", "father"), ("H2", "mother")}
    refs = put(tmp_path / "r.tsv", "From Verse\tTo Verse\tVotes\nGen.1.1\tPs.8.3-Ps.8.5\t12\nGen.1.2\t1Jn.1.1\t-3\nbad\tline\tx\n")
    got = {tuple(r[c] for c in ("from_book", "from_verse_start", "to_book", "to_verse_start", "to_verse_end", "votes")) for r in S.reference_lines(spark, refs).collect()}
    assert got == {("Gen", 1, "Ps", 3, 5, 12), ("Gen", 2, "1Jn", 1, 1, -3)}
    links = put(tmp_path / "links0.csv", "Citation 1,Citation 2,Conection Type\nGenesis 1:1,Tractate 2a,quotation\nTractate 3b,Other 1,x\n")
    assert [r["target"] for r in S.citation_links(spark, links, ["Genesis"]).collect()] == ["Tractate 2a"]
    with pytest.raises(KeyError):
        S.find_columns(["a"], {"source": ("from",)})
    a, b = put(tmp_path / "a.tab", "1\tx\n2\ty\n"), put(tmp_path / "b.tab", "1\tX\n3\tZ\n")
    assert {tuple(r) for r in S.word_columns(spark, {"s": a, "l": b}).collect()} == {(1, "x", "X"), (2, "y", None), (3, None, "Z")}
    tagged = put(tmp_path / "t.txt", "# head\nGen.1.1#01=L\tב/רא\tt\tin/beginning\tH9003/{H7225G}\tHR/Ncfsa\n")
    parts = S.word_elements(S.tagged_words(spark, tagged)).orderBy("part").collect()
    assert [(p["part"], p["number"], p["morph"]) for p in parts] == [(0, "H9003", "HR"), (1, "{H7225G}", "Ncfsa")]
    blocks = put(tmp_path / "b.txt", "intro\n$A\n1\n2\n$B\n3\n")
    assert [(r["block"], r["text"]) for r in S.block_records(spark, blocks, r"^\$").orderBy("line").collect()] == [(1, "$A"), (1, "1"), (1, "2"), (2, "$B"), (2, "3")]


def test_themes(spark, tmp_path):
    names = spark.createDataFrame([("one", "One"), ("on", "One")], "key string, book string")
    verses = spark.createDataFrame([("One", 1, 2, 10)], "book string, chapter int, verse int, verse_id long")
    lines = S.theme_list(spark, put(tmp_path / "t.txt", "# c\nOn 1:2 | core | why\n\nOne 9:9 | borderline |\nOne. 1:2\n"), "th")
    good, bad = S.resolved(lines, verses, names)
    assert good.count() == 2 and [r["role"] for r in bad.collect()] == ["borderline"] and {r["role"] for r in good.collect()} == {"core"}
    path = put(tmp_path / "t.json", json.dumps({"theme_id": "x", "title": "T", "verses": [{"reference": "One 1:2", "role": "core", "reason": None}]}))
    assert S.theme_file(spark, path).first()["reference"] == "One 1:2"


def test_result_store(spark, tmp_path):
    s = W.ResultStore(spark, str(tmp_path))
    t = spark.createDataFrame([("a", 1), ("b", 2)], "word string, n int")
    s.write("r1", "Page", {"top": (t, ["word"])})
    s.write("r1", "Page", {"top": (t, ["word"])})
    assert {(r["run_id"], r["pages"], r["cells"]) for r in s.runs().collect()} == {("r1", 1, 4)}
    assert [tuple(r) for r in s.section("r1", "Page", "top").collect()] == [("a", "1"), ("b", "2")]
    s.write("r2", "Page", {"top": (t.withColumn("n", F.col("n") + F.col("n").isin(2).cast("int")).unionByName(spark.createDataFrame([("c", 9)], "word string, n int")), ["word"])})
    assert sorted((r["row"], r["column_name"], r["change"]) for r in s.diff("r1", "r2").collect()) == [(2, "n", "changed"), (3, "n", "added"), (3, "word", "added")]
    s.keep("r2")
    assert [r["run_id"] for r in s.runs().collect()] == ["r2"]


def test_small_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "book string, n int")
    path = str(tmp_path / "p")
    W.replace_parts(df, path, "book")
    W.replace_parts(spark.createDataFrame([("B", 3)], "book string, n int"), path, "book")
    assert {(r["book"], r["n"]) for r in spark.read.parquet(path).collect()} == {("A", 1), ("B", 3)}
    W.dump(df, str(tmp_path / "d"), ["n"])
    assert [r["n"] for r in spark.read.json(str(tmp_path / "d")).orderBy("n").collect()] == [1, 2]
    assert W.text_table(df.orderBy("n")).splitlines() == ["book  n", "----  -", "A     1", "B     2"]
    c = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "verse_id long, root string")
    assert W.term_counts(c).first()["counts"] == {"x": 2, "y": 1}


@pytest.mark.parametrize("line,kind,args,scope", [
    ("'day' + 'night' [Ezekiel]", "pair", ("day", "night"), "Ezekiel"), ("'day'", "word", ("day",), None), ('"day  of"', "phrase", ("day of",), None), ("1 Garon", "book", ("1 Garon",), None), ("1 Garon 3", "chapter", ("1 Garon", "3"), None),
    ("Orvath 3:4", "verse", ("Orvath", "3", "4"), None), ("Orvath ~ Kelmar", "compare", ("Orvath", "Kelmar"), None), ("kin Orvath 4:1-3", "kin", ("Orvath", "4:1-3"), None), ("@ear and open 0", "passage", ("ear and open 0",), None),
    ("#seed-given", "theme", ("seed-given",), None), ("testament OT", "testament", ("OT",), None),
])
def test_notation(line, kind, args, scope):
    a = N.parse(line)
    assert (a.kind, a.args, a.scope) == (kind, args, scope) and a.describe()


def test_notation_and_sql_guards(spark):
    with pytest.raises(ValueError):
        N.parse("'open")
    assert N.guarded_sql(spark, "select 1 as x -- drop\n;").first()["x"] == 1
    spark.range(5).createOrReplaceTempView("five")
    bad = (
        "drop table x", "select 1; select 2", "with a as (select 1) insert into t select * from a", "select reflect('java.lang.System', 'getenv', 'HOME')", "select try_reflect('java.lang.System', 'getenv', 'HOME')",
        "select * from text.`/etc/hostname`", "select * from parquet.`/tmp`", "select * from other", "select (select max(value) from text.`/etc/hostname`)", "select 1 where exists (select 1 from text.`/etc/hostname`)",
        "select * from five where id in (select java_method('java.lang.Math', 'random'))", "with a as (select * from text.`/etc/hostname`) select * from a", "set a = b", "show tables", "explain select 1", "cache table five", "select",
    )
    for q in bad:
        with pytest.raises(ValueError):
            N.guarded_sql(spark, q)
    assert N.guarded_sql(spark, "select ';drop' as s").first()["s"] == ";drop" and N.guarded_sql(spark, "select '--x' as s").first()["s"] == "--x"
    good = {
        "select count(*) as n from five": 5, "with a as (select * from five) select sum(id) as n from a join five using (id)": 10, "select max(id) as n from five where id in (select id from five where id < 3) having count(*) > 1": 2,
        "select count(*) as n from (select *, row_number() over (partition by id % 2 order by id) as k from five) where k <= 1": 2, "select sum(x) as n from five lateral view explode(array(1, 2)) t as x": 15,
        "select (select max(id) from five) as n": 4, "select size(filter(array(1, 2, 3), x -> x > 1)) as n": 2, "select n from values (1), (7) as t(n) order by n desc": 7,
    }
    for q, want in good.items():
        assert N.guarded_sql(spark, q).first()["n"] == want
    assert N.guarded_sql(spark, "select * from five", 2).count() == 2


@pytest.mark.parametrize("line", ["Orvath", "orv 1", "Orvath 1:1", "Orvath ~ Kel", "testament OT", "#seed-given", "'H4936' [Orvath]", "'H4936' + 'H1840'", '"of the"', "kin Orvath 1", "section Orvath 0"])
def test_pages_have_columns(spark, line):
    page = P.answer(spark, DATA, line)
    assert page and all(df.columns for df in page.values())


def test_page_rows(spark):
    page = P.answer(spark, DATA, "Orvath")
    assert page["totals"].count() == 1 and 0 < page["signature"].count() <= 25


def test_pages_of_a_build_equal_those_of_the_tables(spark, tmp_path):
    """What a page reads from stored facts is what it makes from the tables."""
    names = ["word_chapter", "pull", "echo_places", "synopsis", "kin_ordered", "chapter_strip", "verb_table", "root_verses"]
    build = build_facts(spark, DATA, str(tmp_path), "b1", names)
    a, b = P.answer(spark, DATA, "Orvath 1"), P.answer(spark, DATA, "Orvath 1", build)
    flat = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    assert a.keys() == b.keys() and all(flat(a[k]) == flat(b[k]) for k in a) and a["words"].count() > 0
    assert flat(P.verses_with_root(spark, DATA, "H4936", build=build)) == flat(P.verses_with_root(spark, DATA, "H4936"))


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _stream(spark, tmp_path, build, name):
    e = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    q = build(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return e, spark.table(name)


def test_streamed_windows_agree_with_batch(spark, tmp_path):
    e, got = _stream(spark, tmp_path, V.tumbling, "tumbling_out")
    want = {(r["w"]["start"], r["event_type"]): r["n"] for r in e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    rows = {(r["window"]["start"], r["event_type"]): r["n"] for r in got.collect()}
    assert rows and all(want[k] == n for k, n in rows.items()) and len(rows) >= len(want) - 12


def test_streamed_sessions_and_slides(spark, tmp_path):
    _, got = _stream(spark, tmp_path, V.sessions, "sessions_out")
    assert got.count() > 0
    _, got = _stream(spark, tmp_path, lambda s: V.sliding(s, "1 day", "6 hours"), "slides_out")
    assert got.count() > 0
    e, got = _stream(spark, tmp_path, V.first_seen, "seen_out")
    assert got.count() == e.select("event_id").distinct().count()


def test_streamed_orphans(spark, tmp_path):
    schema = "kind string, ref_table string, ref_id long, key string, at timestamp_ntz"
    rows = [[("ref", "t", 1, "a", "2024-01-02"), ("ref", "t", 2, "b", "2024-01-02")], [("arrival", None, None, "a", "2024-01-05")], [("deletion", None, None, "a", "2024-01-09")]]
    seen = []
    for i, part in enumerate(rows):
        df = spark.createDataFrame(part, "kind string, ref_table string, ref_id long, key string, at string").withColumn("at", F.to_timestamp_ntz("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = V.track_orphans(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "ck"), lambda b, c: seen.append(sorted((r["ref_id"], r["change"]) for r in c.collect())))
        q.awaitTermination()
    assert seen == [[(1, "orphaned"), (2, "orphaned")], [(1, "resolved")], [(1, "reopened")]]


def test_command_line(spark, tmp_path, capsys):
    from quillmark.__main__ import main

    run = lambda *a: main([*a, "--data", DATA], spark)
    run("query", "rate_floors", "--rows", "2")
    run("lift", "--book", "Orvath", "--quiet")
    run("delta", "--book", "Orvath", "--quiet", "--only", "detail")
    run("heat", "--book", "Orvath", "--measure", "rare", "--only", "spots", "--quiet")
    run("ask", "\"of the\"", "--out", str(tmp_path / "o"))
    store = str(tmp_path / "store")
    run("results", "--store", store, "--line", "testament OT", "--run", "r1", "--quiet")
    run("results", "--store", store, "--sql", "select count(distinct section) as n from cells", "--quiet")
    run("results", "--store", store, "--question", "idiom", "--quiet")
    out = capsys.readouterr().out
    assert "rate_floors" in out and "detail 5" in out and "lift " in out and "answer 1" in out and "idiom" in out
    assert spark.read.parquet(str(tmp_path / "o" / "verses")).columns


def test_stores_check_move_restore_and_export(spark, tmp_path):
    from quillmark.sources import files as FI, stores as ST

    t = {"translations": spark.createDataFrame([(1, "A"), (2, "B")], "id int, abbreviation string"), "texts": spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "translation_id int, text string")}
    out = str(tmp_path / "sub")
    for _ in range(2):  # a second copy replaces the first
        ST.subset(t, ["B"], out)
    assert spark.read.parquet(f"{out}/texts").count() == 2 and [p.name for p in tmp_path.iterdir()] == ["sub"]
    state = ST.source_state(spark, f"{out}/texts", "text")
    build = ST.write_build({"texts": t["texts"]}, str(tmp_path), "b", {"source": state})
    assert ST.is_stale(spark, build, source=ST.source_state(spark, f"{out}/texts", "text")) == []
    t["texts"].where("text <> 'x'").write.mode("overwrite").parquet(f"{out}/texts")  # the same rows, another file
    assert ST.is_stale(spark, build, source=ST.source_state(spark, f"{out}/texts", "text")) == []
    assert ST.is_stale(spark, build, source=ST.source_state(spark, f"{out}/texts")) == ["source"]
    t["texts"].write.mode("overwrite").parquet(f"{out}/texts")
    assert ST.is_stale(spark, build, source=ST.source_state(spark, f"{out}/texts", "text")) == ["source"]
    ST.dump(t["texts"].withColumn("n", F.lit(None).cast("double")), str(tmp_path / "d"), ["text"])
    back = ST.restore(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, back.collect())) == [(1, "x", None), (2, "y", None), (2, "z", None)] and back.schema["n"].dataType.simpleString() == "double"
    refs = spark.createDataFrame([("Gen", 1, 1, 1, 1, "Ps", 8, 3, 9, 5, 12), ("1Sam", 2, 3, 2, 4, "Gen", 1, 1, 1, 1, -1)], "from_book string, from_chapter int, from_verse_start int, from_chapter_end int, from_verse_end int, to_book string, to_chapter int, to_verse_start int, to_chapter_end int, to_verse_end int, votes int")
    ST.write_references(refs, str(tmp_path / "r"))
    again = FI.reference_lines(spark, str(tmp_path / "r")).select(*refs.columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, refs.collect()))
    ST.pack(spark, out, str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed" / "texts")).count() == 3
    sets = spark.createDataFrame([("H1 H2", 2, 7), ("H1 H2 H3", 3, 5)], "members string, size int, support long")
    ST.write_sets(sets, spark.createDataFrame([("H1 H2", "A", 1, 4)], "members string, book string, first int, last int"), str(tmp_path / "sets"))
    m = spark.read.parquet(str(tmp_path / "sets" / "members"))
    assert m.count() == 5 and spark.read.parquet(str(tmp_path / "sets" / "windows")).join(m, "set_id").count() == 2
