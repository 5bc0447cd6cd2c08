"""Entries of a bibliography: cut into fragments at punctuation, labelled by a pack of rules in rounds, and read as authors, title and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.functions.rulepack import Pack, Registry, Rule, best, label_sql

#: Where a fragment ends: a quote, a bracket, or a mark before a space; a mark after one letter ends an initial and no fragment.
CUT = r"(?<=[”\"\)\]])[.,;:]?\s*|(?<=[.;:?!])(?<!\b\p{Lu}[.])(?<!\b(?:vol|pp|no|ed|eds)[.])\s+|(?<=,)\s+(?=[“\"])|,\s+(?=(?:Proceedings|Journal|Review|vol\.|pp\.|in\b))|\s+(?=[\(\[“](?:\p{L}|\d))|,\s+(?=(?:19|20)\d\d\b)|(?<=[.])\s+(?=(?:19|20)\d\d[.])"

_W = "PARTITION BY {key} ORDER BY place"


def _truth(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1e0 ELSE 0e0 END"


def features(key: str) -> Registry:
    """The features of fragments (text f, place, n fragments of the entry), and of their neighbours by the round before."""
    w = _W.format(key=key)
    seen = lambda c: _truth(f"max(CASE WHEN {c} THEN 1 ELSE 0 END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1")
    year = r"f RLIKE r'^[\(\[]?(19|20)[0-9]{2}[a-z]?[\)\]]?[.,]?$'"
    words = "size(filter(split(f, '[^\\\\p{L}]+', -1), x -> length(x) > 3 AND x = lower(x)))"
    return Registry().add(
        default="1e0",
        letter=_truth(r"f RLIKE r'\p{L}'"), capital=_truth(r"f RLIKE r'\p{Lu}'"), digit=_truth("f RLIKE '[0-9]'"), year=_truth(year), status=_truth("lower(f) RLIKE 'forthcoming|in press|manuscript'"),
        lonely_capital=_truth(r"f RLIKE r'(^|[ ,])\p{Lu}\.( |,|$)'"), editor=_truth(r"f RLIKE r'(?i)\b(eds?\.|edited by|editors?)'"), dash=_truth(r"f RLIKE r'^[—–-]{1,3}[.,]?$'"),
        first=_truth("place = 0"), near_start=_truth("place <= 1"), early=_truth("place <= 2"), near_end=_truth("n - place <= 2"), quoted=_truth("f RLIKE r'^[“\"].*[”\"][.,]?$'"), bracket=_truth(r"f RLIKE r'^[\(\[]'"),
        label_form=_truth(r"f RLIKE r'^\[[0-9A-Za-z]{1,6}\]$'"), after_year=seen(year), after_quote=seen("f RLIKE '”'"), after_in=_truth(rf"lag(f) OVER ({w}) RLIKE r'(?i)\bin:?$'"),
        long=_truth("length(f) > 20"), dictionary=f"least({words} / greatest(1e0, size(split(f, ' ')) * 0.5e0), 1e0)", names=_truth(r"f RLIKE r'^((\p{Lu}[\p{L}’-]*|\p{Lu}\.)([ ,]+|$)|(and|&) )+$'"),
        venue=_truth(r"f RLIKE r'(?i)\b(journal|review|press|proceedings|vol\.|pp\.|university|quarterly)'"), colon=_truth("f RLIKE ':$'"), number_next=_truth(f"lead(f) OVER ({w}) RLIKE '^[0-9]'"),
        was_author="coalesce(p_AUTHOR, 0e0)", was_title="coalesce(p_TITLE, 0e0)", was_other="greatest(coalesce(p_AUTHOR, 0e0), coalesce(p_TITLE, 0e0), coalesce(p_YEAR, 0e0), coalesce(p_CITLABEL, 0e0))",
        continues_author=f"coalesce(greatest(lag(p_AUTHOR) OVER ({w}), lag(p_CITLABEL) OVER ({w})), 1e0)", follows_year=f"coalesce(lag(p_YEAR) OVER ({w}), 0e0)", follows_author=f"coalesce(lag(p_AUTHOR) OVER ({w}), 0e0)", after_title=f"coalesce(max(p_TITLE) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)",
    )


PACK: Pack = {
    "CITLABEL": [Rule("first", 0.2, -1), Rule("label_form", 0.5, -0.9)],
    "AUTHORDASH": [Rule("dash", 0.5, -1), Rule("near_start", 0.8, -0.8)],
    "AUTHOR": [Rule("letter", 0, -0.7), Rule("capital", 0.1, -0.2), Rule("lonely_capital", 0.25, 0), Rule("editor", -0.6, 0), Rule("digit", -0.7, 0.1), Rule("near_start", 0.7, -0.2), Rule("early", 0.2, -0.4), Rule("quoted", -0.7, 0.05), Rule("status", -0.7, 0), Rule("after_year", -0.4, 0.1), Rule("continues_author", 0.6, -0.6, 2), Rule("names", 0.3, -0.2, 2), Rule("dictionary", -0.2, 0.2, 2), Rule("after_title", -0.4, 0.2, 3)],
    "TITLE": [Rule("default", 0.2, 0), Rule("letter", 0.1, -0.6), Rule("quoted", 0.6, -0.2), Rule("bracket", -0.3, 0), Rule("early", 0.2, -0.6), Rule("after_year", 0.2, -0.1), Rule("after_in", -0.4, 0), Rule("after_quote", -0.4, 0.05), Rule("editor", -0.5, 0), Rule("status", -0.7, 0), Rule("year", -0.9, 0), Rule("was_author", -0.2, 0.05, 2), Rule("venue", -0.4, 0, 2), Rule("long", 0.3, -0.05), Rule(("OR", "follows_year", "follows_author"), 0.6, -0.6, 2), Rule("dictionary", 0.15, -0.15, 2), Rule("names", -0.4, 0.05)],
    "YEAR": [Rule(("OR", "year", "status"), 0.8, -0.8), Rule("year", 0.9, -0.1)],
    "OTHER": [Rule("default", 0.1, 0), Rule("was_other", -0.4, 0.5, 2), Rule("bracket", 0.1, 0, 2), Rule("after_in", 0.2, 0, 2), Rule("number_next", 0.2, 0, 2), Rule("colon", 0.2, 0, 2), Rule("near_end", 0.3, -0.05, 2), Rule("after_quote", 0.15, 0, 2), Rule("editor", 0.6, 0, 2), Rule("venue", 0.4, 0, 2)],
}


def fragments(entries: DataFrame, key: str) -> DataFrame:
    """(key, place, n, f): the fragments of each entry (key, text), made within its row."""
    parts = F.filter(F.split("text", CUT), lambda x: F.trim(x) != "")
    rows = entries.select(key, parts.alias("a")).select(key, F.size("a").alias("n"), F.posexplode(F.transform("a", lambda x: F.trim(x))).alias("place", "f"))
    return rows.select("*", *(F.lit(None).cast("double").alias(f"p_{name}") for name in PACK))


def parse_entries(entries: DataFrame, key: str, rounds: int = 3) -> DataFrame:
    """(key, authors, title, year): the likeliest title (the first of equals), the authors before it in order, and the year where there is one. An entry without a title has none of them; null texts are left out."""
    rows = fragments(entries.where("text IS NOT NULL"), key)
    names = features(key)
    keep = [key, "n", "place", "f"]
    for stage in range(1, rounds + 1):
        rows = rows.selectExpr(*keep, *(f"{label_sql(names, rules, stage)} AS q_{n}" for n, rules in PACK.items())).select(*keep, *(F.col(f"q_{n}").alias(f"p_{n}") for n in PACK))
    rows = rows.selectExpr(*keep, f"{best(PACK)} AS kind", "p_TITLE")
    title = F.max(F.when(F.col("kind") == "TITLE", F.struct("p_TITLE", (-F.col("place")).alias("k"), "f")))
    found = rows.groupBy(key).agg(title.alias("t"), F.array_sort(F.collect_list(F.when(F.col("kind").isin("AUTHOR", "AUTHORDASH"), F.struct("place", "f")))).alias("a"), F.max(F.when(F.col("kind") == "YEAR", F.regexp_extract("f", "([0-9]{4})", 1))).alias("year"))
    authors = F.transform(F.filter("a", lambda x: x["place"] < -F.col("t.k")), lambda x: x["f"])
    clean = lambda c: F.regexp_replace(c, "^[“\"]|[”\"]?[.,]*[”\"]?$", "")
    return found.select(key, F.when(F.col("t").isNotNull(), F.regexp_replace(F.array_join(authors, " "), ",$", "")).alias("authors"), clean(F.col("t.f")).alias("title"), F.when(F.col("t").isNotNull(), F.col("year")).alias("year"))
