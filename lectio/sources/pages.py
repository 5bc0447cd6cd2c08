"""Positioned lines of a table of documents: each line with text gets a page, a place on it and a font, as a reader of page files would give it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a page, and the step from one to the next.
LINES, STEP, TOP, LEFT = 40, 18, 60, 72

_SHAPE = {
    "page_no": "CAST(i DIV 40 + 1 AS INT)",
    "line_no": "CAST(i AS INT)",
    "top": "CAST(60 + 18 * (i % 40) AS INT)",
    "left": "72",
    "width": "CAST(least(468, 6 * length(x)) AS INT)",
    "font_size": "CASE WHEN i = 0 THEN 20 WHEN length(x) < 30 THEN 14 ELSE 11 END",
}

#: The same in DuckDB, as a query.
DUCK = f"SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _SHAPE.items()).replace(' DIV ', ' // ')}, x AS text FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda y: trim(y) <> '') AS l FROM documents WHERE text IS NOT NULL))"


def positioned(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, top, left, width, font_size, text), made within the row of the document. Null texts have no lines."""
    lines = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.expr("filter(split(text, '\n', -1), x -> trim(x) <> '')")).alias("i", "x"))
    return lines.selectExpr("doc_id", *(f"{v} AS {k}" for k, v in _SHAPE.items()), "x AS text")
