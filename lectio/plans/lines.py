"""Lines of documents and turns of conversations as ordered rows."""

from __future__ import annotations

from lectio.functions.dialect import Dialect
from lectio.functions.score import estimate
from lectio.plans.registry import query


def _lines(d: Dialect) -> str:
    """Lines with text, numbered from 0, with the place each has among all lines; both are counted within the row of the document."""
    if d.duck:
        rows = f"(SELECT doc_id, {d.split('text', chr(10))} AS a FROM {d.table('documents')} WHERE text IS NOT NULL) AS d_"
        return f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INT) AS line_no, place, line, length(line) AS n FROM (SELECT doc_id, place, line FROM {d.posexplode(rows, 'a', 'place', 'line')}) AS l_ WHERE trim(line) <> ''"
    kept = "filter(transform(split(text, '\n', -1), (line, place) -> struct(place, line)), x -> trim(x.line) <> '')"
    return f"SELECT doc_id, line_no, x.place AS place, x.line AS line, length(x.line) AS n FROM {d.table('documents')} LATERAL VIEW posexplode({kept}) l_ AS line_no, x WHERE text IS NOT NULL"


_W = "PARTITION BY doc_id ORDER BY line_no"


def heading_sql(d: Dialect) -> str:
    """How likely a line is a heading: short, no full stop, capitals, and a longer line next."""
    return estimate([("CASE WHEN n < 60 THEN 1e0 ELSE 0e0 END", 0.4, -0.8), ("stop", -0.5, 0.3), ("capital", 0.2, -0.4), ("least(n_next / 200e0, 1e0)", 0.3, -0.3)])


def _labelled(d: Dialect) -> str:
    """What a line is like is told before lines are brought together, so only numbers are shuffled."""
    seen = f"SELECT doc_id, line_no, n, CASE WHEN {d.hit('line', '[.!?,;]$')} THEN 1e0 ELSE 0e0 END AS stop, CASE WHEN {d.hit('line', '^[0-9A-Z]')} THEN 1e0 ELSE 0e0 END AS capital FROM ({_lines(d)}) AS a_"
    return f"SELECT doc_id, line_no, n, {heading_sql(d)} AS p FROM (SELECT *, CAST(lead(n) OVER ({_W}) AS DOUBLE) AS n_next FROM ({seen}) AS s_) AS b_"


@query
def score_estimator_lines(d: Dialect) -> str:
    return f"SELECT doc_id, line_no, round(p, 6) AS p_heading FROM ({_labelled(d)}) AS h_"


@query
def line_offsets(d: Dialect) -> str:
    """Characters of a document's lines before each line."""
    return f"SELECT doc_id, line_no, CAST(coalesce(sum(n) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS textpos FROM ({_lines(d)}) AS l_"


@query
def line_gap_above(d: Dialect) -> str:
    """Blank lines between a line and the nearest one before that is longer than five characters."""
    known = d.last_known("CASE WHEN n > 5 THEN place END", f"{_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    return f"SELECT doc_id, line_no, coalesce(place - {known} - 1, -1) AS gap FROM ({_lines(d)}) AS l_"


def _islands(d: Dialect) -> str:
    return f"SELECT *, sum(CASE WHEN short AND NOT coalesce(before, false) OR NOT short AND coalesce(before, true) THEN 1 ELSE 0 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (SELECT *, n < 40 AS short, lag(n < 40) OVER ({_W}) AS before FROM ({_lines(d)}) AS l_) AS s_"


@query
def line_islands(d: Dialect) -> str:
    """Runs of short or long lines, with their length."""
    return f"SELECT doc_id, min(line_no) AS first_line, CAST(count(*) AS INT) AS n_lines, short FROM ({_islands(d)}) AS i_ GROUP BY doc_id, island, short"


@query
def line_run_decay(d: Dialect) -> str:
    """How much the run of likely headings before a line supports it: half of what is missing for each, all from four on."""
    run = "line_no - 1 - " + d.last_known("CASE WHEN p <= 0.5 THEN line_no END", f"{_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    return f"SELECT doc_id, line_no, CASE WHEN run >= 4 THEN 1e0 ELSE 1e0 - power(0.5e0, run) END AS support FROM (SELECT doc_id, line_no, coalesce({run}, line_no) AS run FROM (SELECT * FROM ({_labelled(d)}) AS h_) AS q_) AS r_"


@query
def line_rank_best(d: Dialect) -> str:
    """The likeliest heading of each document and its lead over the next."""
    return f"SELECT doc_id, line_no, round(p, 6) AS p, round(p - coalesce(following, 0e0), 6) AS margin FROM (SELECT *, lead(p) OVER (PARTITION BY doc_id ORDER BY p DESC, line_no) AS following, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, line_no) AS place FROM (SELECT doc_id, line_no, round(p, 9) AS p FROM ({_labelled(d)}) AS h_) AS q_) AS r_ WHERE place = 1"


@query
def line_neighbour_max(d: Dialect) -> str:
    """The best of a line's own and its neighbours' probabilities, which count less with distance."""
    near = ", ".join(f"coalesce({f}(p, {k}) OVER ({_W}), 0e0) * {w}e0" for k, w in ((1, 1.0), (2, 0.7), (3, 0.53)) for f in ("lag", "lead"))
    return f"SELECT doc_id, line_no, round(greatest(p, {near}), 6) AS p FROM ({_labelled(d)}) AS h_"


@query
def line_recurring_headers(d: Dialect) -> str:
    """Texts, without digits and spaces, among the first three lines of more than two documents."""
    bare = d.replace("line", "[0-9 ]+", "")
    return f"SELECT bare, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, {bare} AS bare FROM ({_lines(d)}) AS l_ WHERE line_no < 3) AS b_ GROUP BY bare HAVING count(DISTINCT doc_id) > 2"


@query
def line_propagate_footnote(d: Dialect) -> str:
    """Lines from the first that looks like a footnote or licence on; a page is forty lines."""
    start = f"CASE WHEN {d.hit('line', '(?i)^([*†]|[0-9]+ |licen[sc]ed|this work|all rights)')} THEN 1 ELSE 0 END"
    return f"SELECT doc_id, line_no FROM (SELECT doc_id, line_no, max(start) OVER (PARTITION BY doc_id, CAST(floor(line_no / 40e0) AS INT) ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS note FROM (SELECT doc_id, line_no, {start} AS start FROM ({_lines(d)}) AS l_) AS s_) AS n_ WHERE note = 1"


@query
def line_page_geometry(d: Dialect) -> str:
    """For each page of forty lines its longest line, and the longest before and after each line."""
    w = "PARTITION BY doc_id, page ORDER BY line_no ROWS BETWEEN"
    return f"SELECT doc_id, page, line_no, max(n) OVER (PARTITION BY doc_id, page) AS widest, coalesce(max(n) OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(max(n) OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after FROM (SELECT *, CAST(floor(line_no / 40e0) AS INT) AS page FROM ({_lines(d)}) AS l_) AS p_"


@query
def turn_sequence(d: Dialect) -> str:
    """Turns with the length of the turn before and the place among those of their role."""
    t = d.table("conversations")
    return f"SELECT conv_id, turn, role, coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS before, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS INT) AS nth FROM {t}"
