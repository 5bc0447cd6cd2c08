"""Positioned lines of the documents: statistics, windows, and operators that have to give back the lines that were taken apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lectio.operators import geometry
from lectio.plans.registry import Tables, paired
from lectio.sources.pages import DUCK, positioned
from lectio.sources.positioned import lines_from_xml



def _page() -> WindowSpec:
    return Window.partitionBy("doc_id", "page_no").orderBy("line_no")


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


_BEFORE, _AFTER = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)


def _lines(t: Tables) -> DataFrame:
    return positioned(t("documents", "doc_id", "text"))


@paired(f"""SELECT doc_id, page_no, min("left") AS left_, max("left" + width) AS right_, min(top) AS top_, max(top) AS bottom_, count(*) AS n FROM ({DUCK}) GROUP BY ALL""")
def page_bbox(t: Tables) -> DataFrame:
    """The box of each page's lines."""
    return _lines(t).groupBy("doc_id", "page_no").agg(F.min("left").alias("left_"), F.max(F.col("left") + F.col("width")).alias("right_"), F.min("top").alias("top_"), F.max("top").alias("bottom_"), F.count("top").alias("n"))


@paired(f"""WITH p AS ({DUCK}), b AS (SELECT doc_id, max(page_no) AS pages, max(top) AS bottom FROM p GROUP BY doc_id),
f AS (SELECT p.doc_id, font_size, count(*) AS n FROM p JOIN b USING (doc_id) WHERE length(p.text) >= 10 AND p.top <= 0.7 * bottom AND page_no <= greatest(1, 0.7 * pages) GROUP BY ALL),
r AS (SELECT doc_id, width + "left" AS x, count(*) AS n FROM p GROUP BY ALL)
SELECT b.doc_id, (SELECT font_size FROM f WHERE f.doc_id = b.doc_id ORDER BY n DESC, font_size LIMIT 1) AS font, (SELECT x FROM r WHERE r.doc_id = b.doc_id ORDER BY n DESC, x LIMIT 1) AS right_ FROM b""")
def doc_geometry_mode(t: Tables) -> DataFrame:
    """The usual font (of lines of ten characters in the upper part of the first seven tenths of pages) and right edge of a document."""
    lines, w = _lines(t), Window.partitionBy("doc_id")
    rows = lines.select("doc_id", "page_no", "top", "font_size", (F.col("left") + F.col("width")).alias("x"), F.length("text").alias("n")).withColumns({"pages": F.max("page_no").over(w), "bottom": F.max("top").over(w)})
    usual = (F.col("n") >= 10) & (F.col("top") <= F.lit(0.7) * F.col("bottom")) & (F.col("page_no") <= F.greatest(F.lit(1.0), F.lit(0.7) * F.col("pages")))
    mode = lambda c: F.mode(c, deterministic=True)
    return rows.groupBy("doc_id").agg(mode(F.when(usual, F.col("font_size"))).alias("font"), mode("x").alias("right_"))


@paired(f"""SELECT doc_id, max(CASE WHEN length(text) > 5 THEN (font_size - 11) * 10e0 / 11 END) AS largest, round(stddev_samp(length(text)), 6) AS spread, round(avg(length(text)), 6) AS mean_, round((min(length(text)) + avg(length(text))) / 2, 6) AS middle FROM ({DUCK}) GROUP BY doc_id""")
def line_spread(t: Tables) -> DataFrame:
    """The largest relative font of lines over five characters, and spread, mean and lowered mean of line lengths."""
    n = F.length("text")
    return _lines(t).groupBy("doc_id").agg(F.max(F.when(n > 5, (F.col("font_size") - 11) * 10 / 11)).alias("largest"), F.round(F.stddev_samp(n), 6).alias("spread"), F.round(F.avg(n), 6).alias("mean_"), F.round((F.min(n) + F.avg(n)) / 2, 6).alias("middle"))


@paired(f"""WITH p AS ({DUCK}) SELECT a.doc_id, a.line_no, NOT EXISTS (SELECT 1 FROM p b WHERE b.doc_id = a.doc_id AND b.page_no = a.page_no AND b.line_no > a.line_no AND b.font_size <> a.font_size) AS same FROM p a""")
def font_rest_of_page(t: Tables) -> DataFrame:
    """Whether the rest of the page is in a line's font."""
    rest = _page().rowsBetween(*_AFTER)
    same = (F.min("font_size").over(rest) == F.col("font_size")) & (F.max("font_size").over(rest) == F.col("font_size"))
    return _lines(t).select("doc_id", "line_no", F.coalesce(same, F.lit(True)).alias("same"))


@paired(f"""WITH p AS ({DUCK}) SELECT doc_id, line_no, least(20, (SELECT count(*) FROM p b WHERE b.doc_id = a.doc_id AND b.line_no < a.line_no AND b.font_size > 11)) AS earlier FROM p a""")
def earlier_likely(t: Tables) -> DataFrame:
    """How many lines before are likely headings, twenty at most."""
    n = F.count(F.when(F.col("font_size") > 11, 1)).over(_doc().rowsBetween(*_BEFORE))
    return _lines(t).select("doc_id", "line_no", F.least(n, F.lit(20)).alias("earlier"))


@paired(f"""WITH p AS ({DUCK}), h AS (SELECT doc_id, line_no, font_size FROM p WHERE font_size > 11)
SELECT doc_id, line_no, coalesce((SELECT string_agg(x, '>') FROM (SELECT CAST(h.line_no AS VARCHAR) AS x FROM h WHERE h.doc_id = a.doc_id AND h.line_no < a.line_no ORDER BY h.line_no DESC LIMIT 5)), '') AS ancestors FROM p a""")
def heading_ancestors(t: Tables) -> DataFrame:
    """The five headings before a line, the nearest first. A document's headings are one list beside its lines, of which each line takes its part."""
    lines = _lines(t).select("doc_id", "line_no", (F.col("font_size") > 11).alias("h"))
    last = lines.withColumn("seen", F.count(F.when(F.col("h"), 1)).over(_doc().rowsBetween(*_BEFORE)).cast("int"))
    heads = lines.where("h").groupBy("doc_id").agg(F.array_sort(F.collect_list("line_no")).alias("all"))
    near = "array_join(reverse(slice(all, greatest(seen - 4, 1), least(seen, 5))), '>')"
    return last.join(heads, "doc_id", "left").select("doc_id", "line_no", F.coalesce(F.expr(near), F.lit("")).alias("ancestors"))


@paired(f"""WITH p AS ({DUCK}) SELECT doc_id, line_no, (SELECT coalesce(sum(length(b.text)), 0) FROM p b WHERE b.doc_id = a.doc_id AND b.line_no > a.line_no AND b.line_no < coalesce((SELECT min(c.line_no) FROM p c WHERE c.doc_id = a.doc_id AND c.line_no > a.line_no AND c.font_size > 11), 1000000000)) AS between_ FROM p a WHERE font_size > 11""")
def text_between(t: Tables) -> DataFrame:
    """Characters between each heading and the next, or the end: the difference of two running sums."""
    lines = _lines(t).select("doc_id", "line_no", "font_size", F.length("text").alias("n"))
    lines = lines.withColumn("through", F.sum("n").over(_doc())).withColumn("all", F.sum("n").over(Window.partitionBy("doc_id")))
    heads = lines.where("font_size > 11")
    return heads.select("doc_id", "line_no", (F.coalesce(F.lead(F.col("through") - F.col("n")).over(_doc()), F.col("all")) - F.col("through")).alias("between_"))


@paired(f"""WITH w AS (SELECT doc_id, page_no, max(width) AS width FROM ({DUCK}) GROUP BY ALL) SELECT a.doc_id, a.page_no, coalesce(max(b.width) - min(b.width), 0) AS range_, max(CASE WHEN abs(a.page_no - 2) <= 4 THEN abs(a.page_no - 2) END) AS to_second FROM w a LEFT JOIN w b ON b.doc_id = a.doc_id AND b.page_no BETWEEN a.page_no + 1 AND a.page_no + 8 GROUP BY a.doc_id, a.page_no""")
def page_lookahead(t: Tables) -> DataFrame:
    """The range of widths of the next eight pages, and how far the page with number 2 is, if it is within four."""
    pages = _lines(t).groupBy("doc_id", "page_no").agg(F.max("width").alias("width"))
    ahead = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(1, 8)
    away = F.abs(F.col("page_no") - 2)
    return pages.select("doc_id", "page_no", F.coalesce(F.max("width").over(ahead) - F.min("width").over(ahead), F.lit(0)).alias("range_"), F.when(away <= 4, away).alias("to_second"))


_XML = "documents"


@paired(f"""SELECT doc_id, page_no, line_no % 40 AS line_no, top, "left", width, font_size AS height, font_size, trim(regexp_replace(text, '[<>&]', ' ', 'g')) AS text FROM ({DUCK})""")
def xml_lines(t: Tables) -> DataFrame:
    """Lines written as positioned XML, with a table of fonts on each page and some of the text in bold, and read again: all come back."""
    lines = _lines(t).withColumn("text", F.regexp_replace("text", "[<>&]", " "))
    piece = F.format_string('<text top="%d" left="%d" width="%d" height="%d" font="%d"><b>%s</b>%s</text>', "top", "left", "width", "font_size", F.col("font_size") - 10, F.expr("substr(text, 1, 3)"), F.expr("substr(text, 4)"))
    fonts = "".join(f'<fontspec id="{s - 10}" size="{s}" family="Serif" color="#000000"/>' for s in (11, 14, 20))
    page = lines.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("x")))).alias("a"))
    page = page.select("doc_id", F.concat(F.format_string('<page number="%d" width="612" height="792">' + fonts, "page_no"), F.array_join(F.transform("a", lambda s: s["x"]), "\n"), F.lit("</page>")).alias("xml"))
    return lines_from_xml(page)


@paired("""WITH a AS (SELECT doc_id, regexp_replace(replace(text, '-' || chr(10), ''), '[<>&]', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda y: trim(y) <> ''), ' ') AS text, regexp_matches(text, '[A-Za-z]{5}') AS sane FROM a""")
def xml_text_dump(t: Tables) -> DataFrame:
    """The text of positioned XML with words joined that were parted at a line's end, and whether it has a word of five letters at all."""
    line = lambda x: F.concat(F.lit('<text top="1" font="0">'), x, F.lit("</text>"))
    parts = F.filter(F.split(F.regexp_replace("text", "[<>&]", " "), "\n"), lambda x: F.trim(x) != "")
    xml = t("documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.array_join(F.transform(parts, line), "\n").alias("xml"))
    bodies = F.regexp_extract_all("xml", F.lit("(?s)<text [^>]*>(.*?)</text>"), F.lit(1))
    text = F.regexp_replace(F.regexp_replace(F.array_join(bodies, "\n"), "-\n", ""), "\n", " ")
    return xml.select("doc_id", text.alias("text")).withColumn("sane", F.col("text").rlike("[A-Za-z]{5}"))


def _pieces(lines: DataFrame) -> DataFrame:
    """Each line as up to three pieces that aren't quite on one height."""
    words = F.split(F.trim(F.regexp_replace("text", "[ \t\r]+", " ")), " ")
    parts = F.filter(F.array(F.slice(words, 1, 2), F.slice(words, 3, 3), F.when(F.size(words) > 5, F.slice(words, 6, 100_000)).otherwise(F.array())), lambda x: F.size(x) > 0)
    cut = lines.select("*", F.posexplode(parts).alias("k", "w"))
    return cut.select("doc_id", "page_no", (F.col("top") + F.col("k") % 2).alias("top"), (F.col("left") + 150 * F.col("k")).alias("left"), F.lit(140).alias("width"), "font_size", F.array_join("w", " ").alias("text"))


@paired(rf"""SELECT doc_id, page_no, CAST(line_no % 40 AS BIGINT) AS row_no, trim(regexp_replace(text, '[ \t\r]+', ' ', 'g')) AS text FROM ({DUCK}) WHERE trim(regexp_replace(text, '[ \t\r]+', ' ', 'g')) <> ''""")
def merge_pieces(t: Tables) -> DataFrame:
    """Lines that were cut in pieces are put together again, in reading order."""
    return geometry.merge_pieces(_pieces(_lines(t))).select("doc_id", "page_no", F.col("row_no"), "text")


@paired("""SELECT p_partkey AS doc_id, 1 AS page_no, 'E = mc<sup>2</sup> and H<sub>20</sub> of ' || p_name AS text FROM part""".replace("mc<sup>2</sup>", "mc <sup>2</sup>").replace("H<sub>20</sub>", "H <sub>20</sub>"))
def merge_superscripts(t: Tables) -> DataFrame:
    """Small pieces above or below a line become superscripts and subscripts of it."""
    piece = lambda x, top, size, text: F.struct(F.lit(top).alias("top"), F.lit(x).alias("left"), F.lit(30).alias("width"), F.lit(size).alias("font_size"), text.alias("text"))
    all_ = F.array(piece(10, 100, 12, F.lit("E = mc")), piece(50, 99, 8, F.lit("2")), piece(60, 100, 12, F.lit("and H")), piece(95, 105, 8, F.lit("20")), piece(110, 100, 12, F.concat(F.lit("of "), "p_name")))
    pieces = t("part", "p_partkey", "p_name").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page_no"), F.explode(all_).alias("x")).select("doc_id", "page_no", "x.*")
    return geometry.merge_pieces(pieces).select("doc_id", "page_no", "text")


@paired(f"""SELECT doc_id, page_no, line_no % 40 // 20 AS col, line_no % 40 AS place, line_no FROM ({DUCK})""")
def column_order(t: Tables) -> DataFrame:
    """Pages in two columns of twenty lines: the columns are found and the lines read one column after the other."""
    half = F.floor(F.col("line_no") % 40 / 20).cast("int")
    two = _lines(t).select("doc_id", "page_no", "line_no", (F.lit(60) + F.col("line_no") % 20 * 18).alias("top"), (F.lit(72) + half * 250).alias("left"), F.least("width", F.lit(230)).alias("width"))
    return geometry.columns(two).select("doc_id", "page_no", "col", "place", "line_no")


@paired(f"""SELECT doc_id, page_no, line_no, text FROM ({DUCK}) UNION ALL SELECT doc_id, page_no, -1 - line_no, CAST(line_no AS VARCHAR) FROM ({DUCK}) AS x WHERE (SELECT count(*) FROM ({DUCK}) AS y WHERE y.doc_id = x.doc_id AND y.page_no = x.page_no) <= 5""")
def strip_line_numbers(t: Tables) -> DataFrame:
    """Numbers beside the lines of a page go where there are more than five of them."""
    lines = _lines(t)
    numbers = lines.select("doc_id", "page_no", (-1 - F.col("line_no")).alias("line_no"), "top", (F.lit(40) + F.col("line_no") % 3).alias("left"), "width", "font_size", F.col("line_no").cast("string").alias("text"))
    return geometry.strip_line_numbers(lines.where("NOT text RLIKE '^[0-9]+$'").unionByName(numbers)).select("doc_id", "page_no", "line_no", "text")


@paired(f"""SELECT doc_id, page_no, line_no FROM ({DUCK}) WHERE NOT (line_no % 40 IN (0, 1, 38, 39) AND (regexp_matches(text, '^[-– ]*[0-9]{{1,4}}[-– ]*$')))
UNION ALL SELECT doc_id, 1, -1 FROM ({DUCK}) GROUP BY doc_id HAVING max(page_no) = 1""")
def strip_marginals(t: Tables) -> DataFrame:
    """Running heads and page numbers that are put on every page go again, but for the head of a document of one page, which recurs nowhere."""
    lines = _lines(t).select("doc_id", "page_no", "line_no", "top", "text")
    pages = lines.select("doc_id", "page_no").distinct()
    head = pages.select("doc_id", "page_no", F.lit(-1).alias("line_no"), F.lit(20).alias("top"), F.concat(F.lit("Annals of Examples "), "page_no").alias("text"))
    foot = pages.select("doc_id", "page_no", F.lit(-2).alias("line_no"), F.lit(820).alias("top"), F.col("page_no").cast("string").alias("text"))
    return geometry.without_marginals(lines.unionByName(head).unionByName(foot)).select("doc_id", "page_no", "line_no")


@paired(f"""SELECT doc_id, page_no, line_no % 40 AS line_no, top, 108 AS "left", width, 18 AS font_size, trim(regexp_replace(replace(lower(text), 'p', 'b'), '[^a-z]+', ' ', 'g')) AS text FROM ({DUCK}) WHERE trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) <> ''""")
def hocr_lines(t: Tables) -> DataFrame:
    """Lines written as recognised pages, pixels at 300 dots an inch and zeros for an o within words, and read again."""
    px = lambda c: F.round(c / 1.5 / 72 * 300).cast("int")
    plain = F.trim(F.regexp_replace(F.replace(F.lower("text"), F.lit("p"), F.lit("b")), "[^a-z]+", " "))
    lines = _lines(t).withColumn("plain", plain).where("plain <> ''")
    lines = lines.select("doc_id", "page_no", (F.col("line_no") % 40).alias("line_no"), px(F.col("top")).alias("y"), px(F.lit(108)).alias("x"), px(F.col("width")).alias("w"), F.split(F.regexp_replace(F.regexp_replace("plain", r"(?<=[a-z])o(?=[a-z])", "0"), r"(?<=[a-z])i(?=[a-z])", "1"), " ").alias("words"))
    lines = lines.withColumn("head", F.format_string("<span class='ocrx_word' title='bbox %d %d %d ", "x", "y", F.col("x") + 9))
    word = lambda w: F.concat("head", F.when(w.rlike("[gjqy]"), F.col("y") + 50).otherwise(F.col("y") + 38), F.lit("; x_wconf 90'>"), w, F.lit("</span>"))
    line = F.concat(F.format_string("<span class='ocr_line' title='bbox %d %d %d %d'>", "x", "y", F.col("x") + F.col("w"), F.col("y") + 40), F.array_join(F.transform("words", word), " "), F.lit("</span>"))
    page = lines.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("x")))).alias("a"))
    page = page.select("doc_id", "page_no", F.transform("a", lambda s: s["line_no"]).alias("own"), F.array_join(F.transform("a", lambda s: s["x"]), "\n").alias("hocr"))
    read = geometry.hocr_lines(page, keep=("own",))
    return read.select("doc_id", "page_no", F.get("own", F.col("line_no")).alias("line_no"), "top", "left", "width", "font_size", "text")


@paired(f"""WITH p AS ({DUCK}), q AS (SELECT *, lag(top) OVER w AS above, lag(font_size) OVER w AS above_size FROM p WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no)) SELECT doc_id, line_no, coalesce(top + font_size / 2e0 BETWEEN above AND above + 1.4e0 * above_size, false) AS within_ FROM q""")
def line_within_previous(t: Tables) -> DataFrame:
    """Whether a line's middle lies within the band of the line above on its page."""
    above, size = F.lag("top").over(_page()), F.lag("font_size").over(_page())
    middle = F.col("top") + F.col("font_size") / 2
    return _lines(t).select("doc_id", "line_no", F.coalesce(middle.between(above, above + size * 1.4), F.lit(False)).alias("within_"))


@paired(f"""SELECT doc_id, page_no, line_no FROM ({DUCK})""")
def strip_covers(t: Tables) -> DataFrame:
    """Covers that a repository put before every second document go again, and nothing else does."""
    lines = _lines(t).select("doc_id", "page_no", "line_no", "top", "left", "width", "font_size", "text")
    texts = F.array(F.lit("Repository of Examples"), F.lit("please cite this version as follows"), F.lit("Downloaded from http://x.org, accessed today"))
    cover = t("documents", "doc_id").where("doc_id % 2 = 0").join(lines.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lit(0).alias("page_no"), F.posexplode(texts).alias("k", "text"))
    cover = cover.select("doc_id", "page_no", (-1 - F.col("k")).alias("line_no"), (F.lit(200) + 30 * F.col("k")).alias("top"), F.lit(100).alias("left"), F.lit(700).alias("width"), F.lit(17).alias("font_size"), "text")
    return geometry.without_cover(lines.unionByName(cover)).select("doc_id", "page_no", "line_no")
