"""Golden numbers of the estimators, and what the layout, topic, source and streaming operators must hold."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectio.functions import score
from lectio.operators import layout, topics
from lectio.sources.positioned import lines_from_xml, sample_papers
from lectio.streaming import events


def _value(spark, sql):
    return spark.sql(f"SELECT {sql} AS v").first().v


def test_posterior_goldens(spark):
    assert _value(spark, score.posterior(0.5, [score.binary("true", 0.3, 0.1)])) == pytest.approx(0.75)
    assert _value(spark, score.posterior(1e-4, [score.binary("true", 0.99, 0.01)])) == pytest.approx(0.0098, abs=1e-4)
    assert _value(spark, score.posterior(0.5, [score.binary("CAST(NULL AS BOOLEAN)", 0.3, 0.1)])) == pytest.approx(0.7 / 1.6)
    assert _value(spark, score.posterior(0.5, [score.binary("true", 0.3, 0.1, when="false")])) == pytest.approx(0.5)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 1, 0.8), (5, 3, 0.3), (900, 7, 0.0001), (40, 30, 0.1)])
def test_negative_binomial(spark, k, n, p):
    want = math.exp(math.lgamma(k + n) - math.lgamma(k + 1) - math.lgamma(n) + n * math.log(p) + k * math.log(1 - p))
    assert _value(spark, score.negative_binomial(f"{k}e0", n, p)) == pytest.approx(want, rel=1e-9)


def test_ladder(spark):
    table = [(0, 0.15, 0.7), (1, 0.25, 0.8)]
    assert _value(spark, score.ladder("1", table)) == pytest.approx(math.log(0.1 / 0.1), abs=1e-9)
    assert _value(spark, score.ladder("9", table)) == pytest.approx(math.log(0.75 / 0.2))
    assert _value(spark, score.ladder("CAST(NULL AS INT)", table)) == 0


def _plain(scores):
    pos = neg = 0.5
    up = down = 0.01
    for s in scores:
        if s >= 0:
            pos, up = pos + (1 - pos) * s, up + math.exp((0.5 + s) * 5)
        else:
            neg, down = neg + neg * s, down + math.exp((0.5 - s) * 5)
    return (pos * up + neg * down) / (up + down)


def test_estimators_agree_whatever_the_order(spark):
    random.seed(3)
    for _ in range(5):
        features = [(f"{random.random():.3f}e0", random.uniform(-1, 1), random.uniform(-1, 1)) for _ in range(4)]
        want = _plain([float(f[:-2]) * a + (1 - float(f[:-2])) * b for f, a, b in features])
        assert _value(spark, score.estimate(features)) == pytest.approx(want)
        assert _value(spark, score.estimate_array(features[::-1])) == pytest.approx(want)
    null = [("CAST(NULL AS DOUBLE)", 0.5, -0.5)]
    assert _value(spark, score.estimate(null)) == _value(spark, score.estimate_array(null)) == pytest.approx(0.5)


def test_layout_recovers_metadata(spark):
    lines = sample_papers(spark)
    labelled = layout.label_rounds(lines).cache()
    titles = {r.doc_id: r for r in layout.parse_titles(labelled).collect()}
    assert [titles[i].title for i in range(3)] == ["A Calculus of Reading Rooms", "On the Weight of Evidence", "Why Rules Need Exceptions"]
    assert titles[0].authors == "Ada Lane and Tom Field" and titles[2].authors == "Jon Hill, Eva Brook"
    abstracts = {r.doc_id: r.abstract for r in layout.extract_abstract(labelled).collect()}
    assert all(a.startswith("The question has") and a.endswith("asked of it.") for a in abstracts.values()) and len(abstracts) == 3
    entries = [r for r in layout.parse_bib(labelled).orderBy("doc_id", "entry").collect() if r.doc_id == 0]
    assert [(r.authors, r.year) for r in entries] == [("Lane, Ada", "1998"), ("Field, T. and Brook, E.", "2004"), ("Field, T. and Brook, E.", "2007"), ("Stone, Mary", "2011")]
    assert all(0 < r.confidence <= 1 for r in layout.confidence(layout.parse_titles(labelled), lines).collect())
    none = lines.limit(0)
    assert layout.parse_titles(layout.label_rounds(none)).count() == 0


def test_known_items_are_held_by_plain_containment(spark, tmp_path):
    from lectio.plans.catalogue import QUERIES

    texts = ["On the weight of evidence, a long essay of many more words than that.", "A Calculus of Reading Rooms", "Smart of war and peace in our own times again, it says.", "none of it", None, ""]
    items = ["Weight of Evidence", "a calculus of reading rooms", "rooms", "Art of war and peace in our own time", "essay of many more words than that", "is absent here", "of it", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    want = {(i, j) for i, t in enumerate(texts) for j, k in enumerate(items) if plain(k) and plain(k) in plain(t)}
    got = [(r.doc_id, r.item_id) for r in QUERIES["known_item_contains"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) >= 6


def test_best_reading_is_that_of_all_readings():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n = int(rng.integers(1, 7))
        number, p, q = np.cumsum(rng.integers(1, 3, n)), rng.integers(0, 11, n) / 10, rng.integers(0, 11, n) / 10
        some = (p >= 0.3) | (q >= 0.3)
        number, p, q = number[some], p[some], q[some]
        best = 0.0
        for labels in itertools.product("TA-", repeat=len(number)):
            t, a = ([i for i, x in enumerate(labels) if x == k] for k in "TA")
            if not t or number[t[-1]] - number[t[0]] != len(t) - 1 or min(p[t]) < 0.3 or a and (min(q[a]) < 0.3 or min(a) < t[0] and max(a) > t[-1]):
                continue
            missed = max([max(p[i], q[i]) for i, x in enumerate(labels) if x == "-"], default=0.0)
            best = max(best, p[t].mean() * (min(q[a]) if a else 0.5) * (1 - 0.5 * missed))
        assert layout._best_reading(number, p, q, 0.3)[0] == pytest.approx(best)


def test_title_is_found_among_many_candidates(spark):
    rows = [(1, 2 * i, f"Line {i}", 0.35, 0.3) for i in range(60)] + [(1, 200, "The Real", 0.95, 0.1), (1, 201, "Title", 0.9, 0.1), (1, 203, "Ada Lane", 0.1, 0.9)]
    row = layout.parse_titles(spark.createDataFrame(rows, "doc_id long, line_no long, text string, p_TITLE double, p_AUTHOR double")).first()
    assert (row.title, row.authors) == ("The Real Title", "Ada Lane")


def test_lines_from_xml(spark):
    xml = '<pages><page number="2" width="9"><fontspec id="0" size="17" family="x"/><text top="5" left="7" width="3" height="4" font="0">A <b>bold</b> word</text>\n<text top="9" left="7" width="3" height="4" font="8">Next</text></page></pages>'
    rows = lines_from_xml(spark.createDataFrame([(1, xml), (2, None), (3, "")], "doc_id long, xml string")).orderBy("line_no").collect()
    assert [(r.doc_id, r.page_no, r.line_no, r.top, r.left, r.font_size, r.text) for r in rows] == [(1, 2, 0, 5, 7, 17, "A bold word"), (1, 2, 1, 9, 7, 1, "Next")]


def test_topics_are_learnt(spark):
    docs = spark.createDataFrame([(i, ("mind reason logic " if i % 2 else "garden flower soil ") * 20) for i in range(40)] + [(99, None)], "doc_id long, text string")
    labels = docs.where("doc_id < 30").select("doc_id", (F.col("doc_id") % 2).alias("label"))
    got = {r.doc_id: r.p for r in topics.predict(docs, topics.fit(docs, labels)).collect()}
    assert all(got[i] > 0.5 if i % 2 else got[i] < 0.5 for i in range(30, 40)) and got[99] is None
    assert {r.p for r in topics.predict(docs, topics.fit(docs, labels.limit(0))).collect()} == {topics.UNTRAINED, None}


def test_stream_equals_batch(spark, data):
    batch = spark.read.parquet(f"{data}/events.parquet")
    got = events.drain(events.states(events.read(spark, data)), "complete")
    assert sorted(got.collect()) == sorted(events.states(batch).collect())
