"""Lines put together from what lies on a page: line numbers, pieces, columns, running heads, recognised text.

Each operator is one or two windows over the rows of a page, so it needs one shuffle by document and page, of small rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectio.functions.rulepack import Pack, Registry, Rule, label

PAGE = ("doc_id", "page_no")


def strip_line_numbers(pieces: DataFrame, least: int = 5, near: int = 8) -> DataFrame:
    """pieces without the numbers of lines: where a page has more than `least` pieces of digits alone, those within `near` of their most frequent left edge (the smallest of equals)."""
    digits = F.col("text").rlike("^[0-9]+$")
    edge = F.mode(F.when(digits, F.col("left")), deterministic=True)
    edges = pieces.groupBy(*PAGE).agg(F.count(F.when(digits, 1)).alias("n_"), edge.alias("edge_"))
    return pieces.join(edges, list(PAGE)).where(~(digits & (F.col("n_") > least) & (F.abs(F.col("left") - F.col("edge_")) <= near))).drop("n_", "edge_")


def merge_pieces(pieces: DataFrame, share: float = 1 / 3) -> DataFrame:
    """(doc_id, page_no, row_no, col, top, left, right, font_size, text): pieces (top, left, width, font_size, text) put together to lines in reading order.

    A piece is of the same line as the one above it if the middles of both lie within a share of their height; within a line
    pieces go from left to right, parted by a space, and a short one of a smaller font that stands higher or lower is marked
    as a superscript or subscript. Pieces without text are skipped. Equal places are in the order of their text.
    """
    w = Window.partitionBy(*PAGE)
    by = w.orderBy("middle_", "left", "text")
    rows = pieces.where("trim(text) <> ''").withColumn("middle_", F.col("top") + F.col("font_size") / 2)
    new = F.coalesce(F.col("middle_") - F.lag("middle_").over(by) > share * F.greatest("font_size", F.lag("font_size").over(by)), F.lit(True))
    rows = rows.withColumn("new_", new).withColumn("row_no", F.sum(F.col("new_").cast("int")).over(by) - 1)
    line = Window.partitionBy(*PAGE, "row_no")
    base = F.max(F.struct("font_size", F.col("middle_").alias("m"))).over(line)
    rows = rows.withColumn("base_", base)
    small = (F.length("text") < 4) & (F.col("font_size") < F.col("base_.font_size"))
    high = F.col("base_.font_size") * 0.1
    marked = F.when(small & (F.col("middle_") < F.col("base_.m") - high), F.concat(F.lit("<sup>"), "text", F.lit("</sup>"))).when(small & (F.col("middle_") > F.col("base_.m") + high), F.concat(F.lit("<sub>"), "text", F.lit("</sub>"))).otherwise(F.col("text"))
    out = rows.withColumn("text", marked).groupBy(*PAGE, "row_no").agg(F.min("top").alias("top"), F.min("left").alias("left"), F.max(F.col("left") + F.col("width")).alias("right"), F.max("font_size").alias("font_size"), F.array_sort(F.collect_list(F.struct("left", "text"))).alias("p"))
    return out.select(*PAGE, "row_no", "top", "left", "right", "font_size", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def columns(lines: DataFrame, gap: int = 10) -> DataFrame:
    """lines (top, left, width) with col and place: columns are parted wherever, over the whole page, no line crosses a strip of at least `gap`; place counts from the top of the first column to the end of the last."""
    w = Window.partitionBy(*PAGE)
    by = w.orderBy("left", "top")
    reach = F.max(F.col("left") + F.col("width")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumn("begin_", F.coalesce(F.col("left") >= reach + gap, F.lit(False)).cast("int")).withColumn("col", F.sum("begin_").over(by).cast("int"))
    return rows.withColumn("place", (F.row_number().over(w.orderBy("col", "top", "left")) - 1).cast("int")).drop("begin_")


def without_marginals(lines: DataFrame, margin: int = 25, least: float = 0.5) -> DataFrame:
    """lines without running heads and page numbers: those at the first or last height of their document's pages (within `margin`)
    that score `least`. A line scores by what recurs (the same text but for digits on other pages), by being a number, and by a
    gap to its neighbour that is wider than usual; a document of one page keeps all but numbers."""
    doc = Window.partitionBy("doc_id")
    rows = lines.withColumn("bare_", F.regexp_replace("text", "[0-9 ]+", ""))
    rows = rows.withColumn("edge_", (F.col("top") <= F.min("top").over(doc) + margin) | (F.col("top") >= F.max("top").over(doc) - margin))
    pages = F.size(F.collect_set("page_no").over(Window.partitionBy("doc_id", "bare_", "edge_")))
    by = Window.partitionBy(*PAGE).orderBy("top")
    gap = F.least(F.coalesce(F.col("top") - F.lag("top").over(by), F.lit(10**6)), F.coalesce(F.lead("top").over(by) - F.col("top"), F.lit(10**6)))
    number = F.col("text").rlike("^[-– ]*[0-9]{1,4}[-– ]*$")
    score = F.when(pages > 1, 0.6).otherwise(0.0) + F.when(number, 0.5).otherwise(0.0) + F.when((gap > 25) & (gap < 10**6), 0.2).otherwise(0.0)
    return rows.withColumn("score_", F.when(F.col("edge_"), score).otherwise(0.0)).where(F.col("score_") < least).drop("bare_", "edge_", "score_")


def hocr_lines(pages: DataFrame, dpi: int = 300, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page_no, line_no, top, left, width, font_size, text) of recognised pages (doc_id, page_no, hocr), with further columns of the page to keep beside its lines.

    Boxes are pixels; a page file has 72 points an inch, times 1.5. A line's font is the median of its words' guesses: a
    word's height, a third more where no letter goes below the line. Zeros and ones between letters become o and i.
    """
    number = lambda c: F.round(c.cast("int") / dpi * 72 * 1.5).cast("int")
    line = pages.select(*PAGE, *keep, F.posexplode(F.regexp_extract_all("hocr", F.lit("(?s)(<span class='ocr_line'.*?</span>)\\s*(?=<span class='ocr_line'|</p>|$)"), F.lit(1))).alias("line_no", "line"))
    box = lambda c: F.split(F.regexp_extract(c, r"bbox (\d+ \d+ \d+ \d+)", 1), " ")
    line = line.select(*PAGE, *keep, "line_no", box("line").alias("b"), F.regexp_extract_all("line", F.lit("(?s)(<span class='ocrx_word'[^>]*>.*?</span>)"), F.lit(1)).alias("words"))
    text = lambda w: F.regexp_replace(w, "<[^>]*>", "")
    height = lambda w: (F.get(box(w), 3).cast("int") - F.get(box(w), 1).cast("int")) * F.when(text(w).rlike("[gjpqy]"), 1.0).otherwise(4 / 3)
    # Sizes are used four times, so they are bound by a generator; an empty list of words has a row as well.
    line = line.select("*", F.explode(F.array(F.array_sort(F.transform("words", height)))).alias("sizes"))
    sizes = F.col("sizes")
    middle = (F.get(sizes, F.floor((F.size(sizes) - 1) / 2).cast("int")) + F.get(sizes, F.floor(F.size(sizes) / 2).cast("int"))) / 2
    repaired = F.array_join(F.transform("words", lambda w: F.when(w.rlike(r">[^<]*[01]"), F.regexp_replace(F.regexp_replace(text(w), r"(?<=\p{L}[01]{0,9})0(?=[01]{0,9}\p{L})", "o"), r"(?<=\p{L}1{0,9})1(?=1{0,9}\p{L})", "i")).otherwise(text(w))), " ")
    return line.select(*PAGE, *keep, "line_no", number(F.get("b", 1)).alias("top"), number(F.get("b", 0)).alias("left"), number(F.get("b", 2).cast("int") - F.get("b", 0).cast("int")).alias("width"), F.round(middle / dpi * 72 * 1.5).cast("int").alias("font_size"), repaired.alias("text"))


COVER_WORDS = "repository|downloaded|please cite|available at|this version|issn|terms of use|licen[cs]e|preprint|stable url|accessed"
COVER: Pack = {"COVERPAGE": [Rule("first", 0.1, -0.4), Rule("unusual_width", 0.4, -0.4), Rule("no_normal_font", 0.3, -0.3), Rule("cover_words", 0.4, -0.5), Rule("late_second", 0.3, -0.5), Rule("capital_next", 0.1, -0.4)]}


def usual_fonts(lines: DataFrame, most: int) -> DataFrame:
    """(doc_id, fonts): a map from k = 0 to `most` to the font that is usual after a document's k-th page, with the number of lines there.

    It is the font of the most lines of ten characters, of equals that of the most lines at all, of equals the smallest; 0
    stands for the whole document. A k after which no page comes is missing.
    """
    fonts = lines.groupBy(*PAGE, "font_size").agg(F.count("*").alias("n"), F.count(F.when(F.length("text") >= 10, 1)).alias("long"))
    nth = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page_no"))
    after = fonts.withColumn("nth_", nth).select("doc_id", "font_size", "n", "long", F.explode(F.sequence(F.lit(0), F.least(F.col("nth_") - 1, F.lit(most)))).alias("k"))
    after = after.groupBy("doc_id", "k", "font_size").agg(F.sum("n").alias("n"), F.sum("long").alias("long"))
    usual = F.max_by("font_size", F.when(F.col("font_size").isNotNull(), F.struct("long", "n", -F.col("font_size"))))
    after = after.groupBy("doc_id", "k").agg(usual.alias("usual"), F.sum("n").alias("n"))
    return after.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("usual", "n")))).alias("fonts"))


def without_cover(lines: DataFrame, most: int = 3, tolerance: int = 10, least: float = 0.5) -> DataFrame:
    """lines without the pages before a document's first that are likely covers: of the first `most` pages those up to the last
    that scores `least`, by a pack of rules over pages. A document never loses all of its pages.

    A page's font is held against the one that is usual on the pages after it, since a cover may have more lines than a short
    document; but against the whole document's if fewer than a tenth as many lines come after it, as those are but the rest
    of a text. Words of covers count by lines, where a tenth of a page's lines have some; a page's number is its first or last line.
    """
    doc, place = Window.partitionBy("doc_id"), F.struct("top", "left", "text")
    two, letter = r"^[-– ]*2[-– ]*$", F.col("text").rlike(r"\p{L}")
    ends = F.min_by("text", place).rlike(two) | F.max_by("text", place).rlike(two)
    head = F.min_by("text", F.when(letter, place))
    pages = lines.groupBy(*PAGE).agg(F.max(F.col("left") + F.col("width")).alias("reach"), F.count("*").alias("lines"), F.collect_set("font_size").alias("own"), F.count(F.when(F.lower("text").rlike(COVER_WORDS), 1)).alias("words"), head.alias("head"), ends.alias("second"))
    by = doc.orderBy("page_no")
    ahead = by.rowsBetween(1, 8)
    pages = pages.select("*", F.row_number().over(by).alias("nth"), F.count("page_no").over(doc).alias("n"), F.min("reach").over(ahead).alias("low"), F.max("reach").over(ahead).alias("high"), F.count("reach").over(ahead).alias("following"), F.lead("head").over(by).alias("next"), F.min(F.when(F.col("second"), F.col("page_no"))).over(by.rowsBetween(1, 4)).alias("two"))
    pages = pages.where((F.col("nth") <= most) & (F.col("nth") < F.col("n"))).join(usual_fonts(lines, most), "doc_id")
    pages = pages.withColumn("usual", F.expr("CASE WHEN lines > 10 * fonts[nth].n THEN fonts[0].usual ELSE fonts[nth].usual END"))
    names = Registry().add(
        first="CASE WHEN nth = 1 THEN 1e0 ELSE 0e0 END", unusual_width=f"CASE WHEN following >= 3 THEN CASE WHEN reach BETWEEN low - {tolerance} AND high + {tolerance} THEN 0e0 ELSE 1e0 END END",
        no_normal_font="CASE WHEN array_contains(own, usual) THEN 0e0 WHEN exists(own, f -> abs(f - usual) < 2) THEN 0.5e0 ELSE 1e0 END", cover_words="CASE WHEN words = 0 OR 10 * words < lines THEN 0e0 ELSE least(1e0, 0.5e0 + words / 6e0) END",
        late_second="CASE WHEN two IS NOT NULL THEN CASE WHEN two - page_no > 1 THEN 1e0 ELSE 0e0 END END", capital_next=r"CASE WHEN next IS NOT NULL THEN CASE WHEN next RLIKE r'^\P{L}*\p{Lu}' THEN 1e0 ELSE 0e0 END END",
    )
    scored = label(pages, names, COVER).where(F.col("p_COVERPAGE") >= least)
    last = scored.groupBy("doc_id").agg(F.max("page_no").alias("last_"))
    return lines.join(last, "doc_id", "left").where("last_ IS NULL OR page_no > last_").drop("last_")
