"""Rule packs, page geometry, addresses, the shared folder and streams that go on, by small cases."""

from __future__ import annotations

import itertools
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lectio import session as sessions
from lectio.functions.rulepack import Registry, Rule, best, f_and, f_or, label, label_sql
from lectio.operators import geometry
from lectio.plans.linked import person, same_person
from lectio.streaming import events


def test_fuzzy_combinators_are_null_if_an_operand_is(spark):
    values = ["NULL", "0.2e0", "0.7e0"]
    for some in itertools.product(values, repeat=3):
        row = spark.sql(f"SELECT {f_or(*some)} AS o, {f_and(*some)} AS a").first()
        numbers = [float(v[:-2]) for v in some if v != "NULL"]
        assert (row.o, row.a) == ((None, None) if len(numbers) < 3 else (max(numbers), min(numbers)))


def test_rules_count_by_stage_and_replace_one_another(spark):
    assert [Rule("a", 1, 0, s).counts(2) for s in (0, 1, 2, 3, -1, -2, -3)] == [True, True, True, False, False, True, True]
    assert [Rule("a", 1, 0, s).counts(None) for s in (0, 1, -1)] == [True, False, False]
    names = Registry().add(short="CASE WHEN length(text) < 5 THEN 1e0 ELSE 0e0 END", digit="CASE WHEN text RLIKE '[0-9]' THEN 1e0 ELSE 0e0 END")
    pack = {"NUMBER": [Rule("digit", 0.1, 0.1), Rule("digit", 0.8, -0.8), Rule("short", 0.2, -0.2)], "WORD": [Rule(("AND", "short", ("OR", "digit", "short")), 0.3, -0.1), Rule("digit", -0.9, 0.4, 2)]}
    rows = label(spark.createDataFrame([("12",), ("word",), ("longer words",)], "text string"), names, pack, rounds=2)
    got = {r.text: (r.p_NUMBER, r.p_WORD, r.best) for r in rows.selectExpr("*", f"{best(pack)} AS best").collect()}
    assert got["12"][0] > 0.5 > got["word"][0] and got["12"][2] == "NUMBER" and got["word"][2] == "WORD"
    assert "0.1" not in label_sql(names, pack["NUMBER"]) and label_sql(names, pack["WORD"], 1) != label_sql(names, pack["WORD"], 2)
    with pytest.raises(KeyError):
        names.compile("unknown")


def test_names_in_either_order(spark):
    same = [("John Smith", "Smith, John"), ("J. Smith", "John Smith"), ("Anna Müller", "A. Muller"), ("Tom van Dyke", "van Dyke, T."), ("John M. Smith", "Smith, John")]
    other = [("John Smith", "Jane Smith"), ("Smith", "John Smith"), ("John Smith", "John Smythe"), ("A. Smith", "J. Smith"), ("Bob Jones", "Smith, Bob")]
    rows = spark.createDataFrame([(a, b) for a, b in same + other], "a string, b string").select(same_person(person("a"), person("b")).alias("s"))
    assert [r.s for r in rows.collect()] == [True] * len(same) + [False] * len(other)


def test_geometry_of_odd_pages(spark):
    schema = "doc_id long, page_no int, top int, left int, width int, font_size int, text string"
    pieces = spark.createDataFrame([(1, 1, 100, 300, 50, 12, "two"), (1, 1, 101, 10, 50, 12, "one"), (1, 1, 120, 10, 50, 12, " "), (1, 1, 140, 10, 50, 12, "three"), (2, 1, 0, 0, 0, 12, "alone")], schema)
    assert [(r.doc_id, r.row_no, r.text) for r in geometry.merge_pieces(pieces).orderBy("doc_id", "row_no").collect()] == [(1, 0, "one two"), (1, 1, "three"), (2, 0, "alone")]
    assert geometry.merge_pieces(pieces.limit(0)).count() == 0 and geometry.columns(pieces.limit(0)).count() == 0 and geometry.without_marginals(pieces.limit(0)).count() == 0
    three = spark.createDataFrame([(1, 1, 10 * r, 100 * c, 80, 10, f"{c}{r}") for c in range(3) for r in range(2)] + [(2, 1, 0, 0, 300, 10, "across"), (2, 1, 10, 0, 80, 10, "a"), (2, 1, 10, 100, 80, 10, "b")], schema)
    got = [(r.doc_id, r.col, r.text) for r in geometry.columns(three).orderBy("doc_id", "place").collect()]
    assert got == [(1, 0, "00"), (1, 0, "01"), (1, 1, "10"), (1, 1, "11"), (1, 2, "20"), (1, 2, "21"), (2, 0, "across"), (2, 0, "a"), (2, 0, "b")]


def test_covers_of_odd_documents(spark, tmp_path):
    import duckdb

    from lectio.plans.catalogue import ORACLE_SQL, QUERIES

    line, after = "a line of plain words that goes on for a while", "Next page begins here and goes on for long"
    licence, words = "Licensed under the Apache License, Version 2.0.", "available at the repository, accessed today"
    texts = [
        "un.\nand thirty characters more of it", "x", "hello\nyou", "2", "12345\nHello, a line after a number", "lower\n2\nand more than thirty characters on a line", "", None,  # shorter than the cover
        "\n".join([line] * 3 + ["w"] * 3), "\n".join(["abc"] * 130), "\n".join([line] * 39 + ["2"] + [line] * 300),
        "\n".join([line] * 39 + [licence] + [after] * 5), "\n".join([line] * 38 + [licence] * 2 + [after] * 5), "\n".join([line] * 39 + [words, after]),  # a text that has words of covers
        "\n".join([line] * 40 + ["Some short end."]), "\n".join([line] * 39 + [licence, "Some short end."]),  # a rest in another font
    ]
    docs = spark.createDataFrame([(2 * k + odd, text) for k, text in enumerate(texts) for odd in (0, 1)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((r.doc_id, r.page_no, r.line_no) for r in QUERIES["strip_covers"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(ORACLE_SQL["strip_covers"]).fetchall())


def test_fonts_after_each_page(spark):
    schema = "doc_id long, page_no int, top int, left int, width int, font_size int, text string"
    page = lambda doc, no, *sizes, text="ten letters": [(doc, no, 10 * i, 0, 100, s, text) for i, s in enumerate(sizes)]
    lines = spark.createDataFrame(page(1, 0, 17, 17, 17) + page(1, 3, 20, 11) + page(1, 4, 20, 20) + page(2, 1, 12, 12, 9, text="short") + page(3, 1, None, None), schema)
    got = {r.doc_id: {k: tuple(v) for k, v in r.fonts.items()} for r in geometry.usual_fonts(lines, 3).collect()}
    assert got == {1: {0: (17, 7), 1: (20, 4), 2: (20, 2)}, 2: {0: (12, 3)}, 3: {0: (None, 2)}}
    assert geometry.without_cover(lines).count() == 12 and geometry.without_cover(lines.limit(0)).count() == 0
    cover = spark.createDataFrame([(1, 0, 200 + 30 * i, 0, 700, 17, t) for i, t in enumerate(["Repository", "please cite", "accessed"])], schema)
    assert {r.page_no for r in geometry.without_cover(lines.where("page_no > 0").unionByName(cover)).where("doc_id = 1").collect()} == {3, 4}


def test_the_shared_folder(spark, tmp_path):
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        sessions.shared_dir(unset)
    sessions.sweep(spark)
    kept = sessions.materialise(spark.range(3).toDF("x"), "some")
    path = sessions._WRITTEN[-1].removeprefix("file:")
    assert kept.count() == 3 and list(Path(path).glob("*.parquet"))
    sessions.sweep(spark)
    assert not Path(path).exists() and not sessions._WRITTEN


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    folder, base = tmp_path / "in", f"file://{tmp_path}/state"
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 5).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows(0, 4).coalesce(1).write.mode("append").parquet(str(folder))
    stream = lambda: spark.readStream.schema(rows(0, 1).schema).parquet(str(folder))
    assert events.drain(events.states(stream()), "complete", base).count() == 4
    rows(4, 12).coalesce(1).write.mode("append").parquet(str(folder))
    got = {r.source_id: r.n for r in events.drain(events.states(stream()), "complete", base).collect()}
    assert got == {0: 3, 1: 3, 2: 2, 3: 2, 4: 2}


def test_citations_that_lack_parts(spark):
    from lectio.operators import bibliography

    rows = [(1, "Lane, Ada (1998). A map of small rooms. Journal of Rooms 3: 1-20."), (2, "— (2007). More exceptions to the rules. Northern Press."), (3, ""), (4, None), (5, "[12] M. Stone, “Weighing evidence twice”, Review of Weights, 2011.")]
    got = {r.k: (r.authors, r.title, r.year) for r in bibliography.parse_entries(spark.createDataFrame(rows, "k long, text string"), "k").collect()}
    assert got == {1: ("Lane, Ada", "A map of small rooms", "1998"), 2: ("—", "More exceptions to the rules", "2007"), 5: ("M. Stone", "Weighing evidence twice", "2011")}
    assert bibliography.parse_entries(spark.createDataFrame([], "k long, text string"), "k").count() == 0


def test_command_line(spark, data, tmp_path, capsys):
    from lectio import cli

    assert cli.main(["list"]) == 0 and "score_paper" in capsys.readouterr().out.split()
    assert cli.main(["run", "doc_wordcount", data, "--to", str(tmp_path / "out"), "--format", "json"], spark) == 0
    assert spark.read.json(str(tmp_path / "out")).count() == 200
    assert cli.main(["document", data, "7"], spark) == 0 and '"title":"On the Weight of' in capsys.readouterr().out
    assert '"error"' in cli.document(spark, data, -1)


def test_plans_have_no_needless_exchange(spark, data):
    from lectio.plans.catalogue import QUERIES

    plan = lambda name: QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    for name in ("due_new", "due_ok", "due_broken"):
        assert "SinglePartition" not in plan(name)
    assert plan("due_priority").count("TakeOrderedAndProject") >= 1
    for name in ("doc_linestats", "score_link", "page_session_vars", "url_resolve"):
        assert "Exchange" not in plan(name)
    assert "line#" not in plan("line_rank_best").split("Exchange", 1)[0].rsplit("Window", 1)[-1]
