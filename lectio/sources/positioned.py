"""Positioned text: pages of <text> elements with fonts, and a few small papers to try the layout operators on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, page_no int, line_no int, top int, left int, width int, height int, font_size int, text string"


def lines_from_xml(pages: DataFrame) -> DataFrame:
    """Lines of (doc_id, xml), numbered in the order of the file: fonts are looked up by number (size 1 where one isn't declared), inline tags go, and words parted at a line's end are joined by later steps."""
    attr = lambda c, name: F.coalesce(F.expr(f"try_cast(regexp_extract({c}, '\\\\b{name}=\"(-?[0-9]+)\"', 1) AS INT)"), F.lit(0))
    page = pages.select("doc_id", F.posexplode(F.expr("regexp_extract_all(xml, '(?s)(<page .*?</page>)', 1)")).alias("p", "page"))
    fonts = F.expr("regexp_extract_all(page, '(<fontspec [^>]*>)', 1)")
    # Both are bound before the lines are parted: beside a generator they would be sought in the whole page again for each of its lines.
    page = page.select("doc_id", "page", F.explode(F.array(F.struct(F.coalesce(attr("page", "number"), F.col("p") + 1).alias("page_no"), fonts.alias("fonts")))).alias("h"))
    line = page.select("doc_id", F.col("h.page_no").alias("page_no"), F.col("h.fonts").alias("fonts"), F.posexplode(F.expr("regexp_extract_all(page, '(?s)(<text [^>]*>.*?</text>)', 1)")).alias("line_no", "line"))
    size = F.expr("coalesce(try_cast(regexp_extract(get(filter(fonts, f -> f LIKE concat('%id=\"', font, '\"%')), 0), 'size=\"([0-9]+)\"', 1) AS INT), 1)")
    line = line.withColumn("font", F.regexp_extract("line", r'font="([0-9]+)"', 1))
    return line.select("doc_id", "page_no", "line_no", *(attr("line", n).alias(n) for n in ("top", "left", "width", "height")), size.alias("font_size"), F.trim(F.regexp_replace("line", "<[^>]*>", "")).alias("text"))


_TITLES = [("A Calculus of Reading Rooms", "Ada Lane and Tom Field"), ("On the Weight of Evidence", "Mary Stone"), ("Why Rules Need Exceptions", "Jon Hill, Eva Brook")]
_BODY = ["The question has a long history, and most answers share a premise that is seldom stated.", "I shall state it here and show that it is false in each of the cases that matter.", "What is left is a weaker claim, which is true and does all the work that was asked of it."]
_BIBLIOGRAPHY = ["Lane, Ada (1998). A map of small rooms. Journal of Rooms 3: 1-20.", "Field, T. and Brook, E. (2004). Exceptions to rules. Northern Press.", "— (2007). More exceptions to rules. Northern Press.", "Stone, Mary (2011). Weighing evidence twice. Review of Weights 9: 44-61."]


def sample_papers(spark: SparkSession, copies: int = 1) -> DataFrame:
    """Three papers of two pages each, as positioned lines."""
    rows = []
    for doc in range(3 * copies):
        title, authors = _TITLES[doc % 3]
        page = [(title, 24), (authors, 14), ("Abstract", 12), *((b, 10) for b in _BODY), ("1 Introduction", 14), *((b, 12) for b in _BODY * 3)]
        rest = [("2 Conclusion", 14), *((b, 12) for b in _BODY * 2), ("References", 14), *((b, 10) for b in _BIBLIOGRAPHY)]
        n = 0
        for number, part in ((1, page), (2, rest)):
            for i, (text, size) in enumerate(part):
                rows.append((doc, number, n, 80 + 24 * i + 40 * (size == 14), 90, 6 * len(text), size, size, text))
                n += 1
    return spark.createDataFrame(rows, SCHEMA)
