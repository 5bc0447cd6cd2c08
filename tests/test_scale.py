"""What keeps queries in proportion to their input, and results that larger tables showed to be wrong."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectio.operators import pairs


@pytest.fixture(scope="module")
def titles(spark):
    names = ["red ring", "rad ring", "old bolt"]
    return spark.createDataFrame([(i, names[i * i % 3], i % 2) for i in range(600)] + [(5, "red ring", 0)], "id long, name string, g int")


def test_pairs_are_of_classes_and_expand_to_all_rows(spark, titles, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 64)
    near = pairs.alike(pairs.classes(titles, "id", "g", "name"), ["g"], "name", "levenshtein(a.name, b.name, 2) >= 0")
    assert near.count() < 60 and near.agg(F.max(F.size("ia"))).first()[0] <= 64
    got = sorted(map(tuple, pairs.expand(near).collect()))
    rows = [tuple(r) for r in titles.collect()]
    alike = lambda x, y: x == y or {x, y} == {"red ring", "rad ring"}
    assert got == sorted((a, b) for a, n, g in rows for b, m, h in rows if g == h and a < b and alike(n, m))


def _equals_sql(spark, tmp_path, name, texts):
    """A query against its SQL over documents with these texts."""
    import duckdb

    from lectio.plans.catalogue import ORACLE_SQL, QUERIES

    docs = spark.createDataFrame([(i, x, "en", "books", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_entries_with_empty_titles_and_wide_spaces(spark, tmp_path):
    _equals_sql(spark, tmp_path, "encyclopedia_page", ["", "\nabc", "<>&\nx", " A title　\nx", "a b\r\nx", " one two ", "\t tab\n"])


def test_abstract_holds_lines_that_begin_as_headings_do(spark, tmp_path):
    rest = "\nThe others are of no interest here, and they say so at length.\n" * 3
    _equals_sql(spark, tmp_path, "extract_abstract", [f"{first}\nAll rights are reserved." + rest for first in ("4537960215852590 Then there is the other one, and all of it.", "Literature on this is large, and most of it is old.", "References to rooms are found in all of these texts.", "A map of rooms.")])


def test_running_estimate_equals_whole_estimate(spark):
    from lectio.functions.score import estimate_array, estimate_more, estimate_parts, score

    own, more = [("x", 0.8, -0.5), ("y", 0.3, -0.9), ("1e0", 0.2, 0.0)], [("z", 0.4, -0.3)]
    rows = spark.createDataFrame([(x / 4, y / 4, z / 4) for x in range(5) for y in range(5) for z in range(5)], "x double, y double, z double")
    got = rows.selectExpr("*", *estimate_parts(own, "p")).selectExpr(f"{estimate_array(own + more)} AS a", f"{estimate_more('p', [score(*more[0])])} AS b", f"{estimate_array(own)} AS c", f"{estimate_more('p', [])} AS d")
    assert all(abs(r.a - r.b) < 1e-15 and abs(r.c - r.d) < 1e-15 for r in got.collect())


def test_pages_are_searched_once_not_for_each_line(spark, data):
    from lectio.plans.catalogue import QUERIES

    plan = QUERIES["xml_lines"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "(<fontspec" in plan and "(<fontspec" not in plan.split("Generate posexplode(regexp_extract_all")[0]
    assert "Join" not in QUERIES["hocr_lines"](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_copies_are_one_class_of_near_copies(spark, tmp_path):
    words = "alpha bravo charlie delta foxtrot golfing hotel india juliet kilogram limas mikes november oscar papa quebec romeo sierra tango uniform victor whisky"
    texts = [words, words, words + " zuluu", words, words + " zuluu yankee", "one two", "", "", words.upper()] * 3
    _equals_sql(spark, tmp_path, "dup_blocked", texts)
    from lectio.plans.catalogue import QUERIES

    assert "collect_list(doc_id" in QUERIES["dup_blocked"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
