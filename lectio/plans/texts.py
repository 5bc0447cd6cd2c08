"""Documents: counts, features, scores, and duplicates."""

from __future__ import annotations

from lectio.functions.dialect import Dialect
from lectio.functions.score import binary, count_ratio, posterior
from lectio.plans.registry import query

COURSE = "course|exam|homework|handout|grading|lecture|seminar|hours/"
PAPER = "in section|finally,"
INTERVIEW = "interview|do you|did you"
#: Words of a page, where a document has none of its own.
PAGE_WORDS = 300


def n_words(d: Dialect, text: str = "text") -> str:
    return f"(CASE WHEN trim({text}) = '' THEN 0 ELSE {d.count(text, '[^ \t\r\n]+')} END)"


def line_lengths(d: Dialect, text: str = "text") -> str:
    return d.map(d.filter(d.split(text, chr(10)), "x", "trim(x) <> ''"), "x", "length(x)")


def _rate(d: Dialect, terms: str) -> str:
    """Occurrences of some terms, which don't overlap, for each 10 000 words: by what is lost when they are replaced, which takes no pattern."""
    total = " + ".join(f"(length(low) - length(replace(low, '{t}', ''))) / {len(t)}" for t in terms.split("|"))
    if d.duck:
        total = d.count("low", terms)
    return f"CAST(floor(({total}) * 10000e0 / greatest(words, 1)) AS DOUBLE)"


def _verb_rate(d: Dialect) -> str:
    """The same for words of their own."""
    hits = d.size(d.filter(d.split("text", r"[^\p{L}]+"), "v", "v IN ('is', 'est', 'ist', 'es')"))
    return f"CAST(floor({hits} * 10000e0 / greatest(words, 1)) AS DOUBLE)"


def _counted(d: Dialect) -> str:
    return f"SELECT *, {n_words(d)} AS words, lower(text) AS low FROM {d.table('documents')} WHERE text IS NOT NULL"


@query
def doc_wordcount(d: Dialect) -> str:
    return f"SELECT doc_id, words FROM ({_counted(d)}) AS c_"


@query
def doc_ocr_extrapolate(d: Dialect) -> str:
    """Words of a document of which ten pages were read: extrapolated to all of its pages, here one for 300 words of its characters."""
    return f"SELECT doc_id, pages, CAST(CASE WHEN pages > 10 THEN floor(words * pages / 10e0) ELSE words END AS BIGINT) AS words FROM (SELECT *, CAST(ceil(n_chars / 2000e0) AS INT) AS pages FROM ({_counted(d)}) AS c_) AS p_"


@query
def doc_linestats(d: Dialect) -> str:
    """Lines with text, and the median, shortest and longest of them."""
    return f"SELECT doc_id, {d.size('a')} AS n_lines, coalesce(CAST({d.median('a')} AS DOUBLE), 0e0) AS median_len, coalesce({'list_min(a)' if d.duck else 'array_min(a)'}, 0) AS shortest, coalesce({'list_max(a)' if d.duck else 'array_max(a)'}, 0) AS longest FROM (SELECT doc_id, {line_lengths(d)} AS a FROM {d.table('documents')} WHERE text IS NOT NULL) AS l_"


@query
def doc_mode_linelen(d: Dialect) -> str:
    """The most frequent length of a document's lines, in tens; of equally frequent ones the least."""
    rows = f"(SELECT doc_id, {line_lengths(d)} AS a FROM {d.table('documents')} WHERE text IS NOT NULL) AS l_"
    return f"""SELECT doc_id, tens AS mode_len, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, tens) AS place FROM
(SELECT doc_id, CAST(floor(len / 10e0) AS INT) AS tens, count(*) AS n FROM {d.explode(rows, 'a', 'len')} GROUP BY doc_id, CAST(floor(len / 10e0) AS INT)) AS g_) AS r_ WHERE place = 1"""


@query
def doc_keyword_rates(d: Dialect) -> str:
    """Occurrences for each 10 000 words."""
    return f"SELECT doc_id, {_rate(d, COURSE)} AS course, {_rate(d, PAPER)} AS paper, {_rate(d, INTERVIEW)} AS interview, {_verb_rate(d)} AS verbs FROM ({_counted(d)}) AS c_"


@query
def doc_feature_text(d: Dialect) -> str:
    """The text that topics are learnt from: content (of a long one the first and last 50 000 characters), length twice, first line twice, type and source."""
    size = "CASE WHEN n < 4000 THEN 'XTINY' WHEN n < 8000 THEN 'XVSHORT' WHEN n < 15000 THEN 'XSHORT' WHEN n < 40000 THEN 'XMEDIUM' WHEN n < 80000 THEN 'XLONG' ELSE 'XVLONG' END"
    title = f"{d.extract('text', f'^([^{chr(10)}]*)')}"
    return f"""SELECT doc_id, concat(CASE WHEN n >= 100000 THEN concat(substr(text, 1, 50000), substr(text, n - 49999, 50000)) ELSE text END, ' ', size, ' ', size, ' ', title, ' ', title, ' XPATH_', source, ' XTYPE_', lang) AS feature_text
FROM (SELECT *, {size} AS size FROM (SELECT doc_id, text, source, lang, length(text) AS n, {title} AS title FROM {d.table('documents')} WHERE text IS NOT NULL) AS a_) AS b_"""


def _abstract(d: Dialect, least: int, tail: str) -> str:
    """Sentences of the first thousand characters until there are so many characters."""
    parts = d.extract_all("substr(text, 1, 1000)", r"[^.!?]+[.!?]*[ \n]*", 0)
    rows = f"(SELECT doc_id, {parts} AS a FROM {d.table('documents')} WHERE text IS NOT NULL) AS p_"
    gathered = "string_agg(s, '' ORDER BY place)" if d.duck else "array_join(transform(array_sort(collect_list(struct(place, s))), x -> x.s), '')"
    return f"""SELECT doc_id, concat(trim({gathered}), '{tail}') AS abstract FROM (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM (SELECT doc_id, place, s FROM {d.posexplode(rows, 'a', 'place', 's')}) AS s_) AS w_ WHERE before <= {least} GROUP BY doc_id"""


@query
def doc_abstract_200(d: Dialect) -> str:
    return _abstract(d, 200, " &hellip;")


@query
def doc_abstract_600(d: Dialect) -> str:
    return _abstract(d, 600, "")


@query
def doc_hyphen_join(d: Dialect) -> str:
    """Words that were parted at a line's end, joined."""
    joined = d.replace("text", "-\n", "")
    return f"SELECT doc_id, {joined} AS text, length(text) - length({joined}) AS removed FROM {d.table('documents')} WHERE text IS NOT NULL"


@query
def doc_ascii_fold(d: Dialect) -> str:
    return f"SELECT doc_id, {d.fold('text')} AS folded FROM {d.table('documents')} WHERE text IS NOT NULL"


@query
def doc_title_truncate(d: Dialect) -> str:
    """The first line as a title of 255 characters at most."""
    title = d.extract("text", f"^([^{chr(10)}]*)")
    return f"SELECT doc_id, CASE WHEN length(t) > 255 THEN concat(substr(t, 1, 251), '...') ELSE t END AS title FROM (SELECT doc_id, {title} AS t FROM {d.table('documents')} WHERE text IS NOT NULL) AS t_"


def _features(d: Dialect) -> str:
    return f"""SELECT doc_id, lang, source, n_chars, CAST(words AS DOUBLE) AS words, substr(text, 1, 5000) AS head, {_rate(d, COURSE)} AS course, {_rate(d, PAPER)} AS paper, {_rate(d, INTERVIEW)} AS interview, {_verb_rate(d)} AS verbs,
({' OR '.join(f"contains(low, '{t}')" for t in ('bibliograph', 'references', 'literatur'))}) AS bib, CAST(floor({d.median(line_lengths(d))}) AS DOUBLE) AS line_len, CASE WHEN n_chars >= 4000 THEN floor(words * 2000e0 / n_chars) END AS per_page FROM ({_counted(d)}) AS c_"""


def _paper(d: Dialect) -> str:
    """Probability that a document is a paper, by its words and layout."""
    c = lambda k, y, n: count_ratio(k, y, n, True)
    ratios = [c("course", (1, 0.8), (2, 0.2)), c("paper", (2, 0.3), (1, 0.6)), c("interview", (1, 0.8), (1, 0.2)), c("verbs", (30, 0.1), (2, 0.01)), c("words", (3, 0.0002), (1, 0.0002)), binary("bib", 0.8, 0.2), c("line_len", (3, 0.03), (2, 0.04)), c("per_page", (4, 0.01), (3, 0.01))]
    return posterior(0.6, ratios)


@query
def score_paper(d: Dialect) -> str:
    return f"SELECT doc_id, lang, round(p, 6) AS p_paper, p > 0.5 AS is_paper FROM (SELECT *, {_paper(d)} AS p FROM ({_features(d)}) AS f_) AS q_"


@query
def score_paper_by_lang(d: Dialect) -> str:
    """Precision and recall of the paper filter against the quality labels, by language."""
    return f"""SELECT lang, count(*) AS n, round(sum(CASE WHEN p > 0.5 AND quality = 1 THEN 1e0 ELSE 0e0 END) / nullif(sum(CASE WHEN p > 0.5 THEN 1e0 ELSE 0e0 END), 0e0), 6) AS precision_, round(sum(CASE WHEN p > 0.5 AND quality = 1 THEN 1e0 ELSE 0e0 END) / nullif(sum(CASE WHEN quality = 1 THEN 1e0 ELSE 0e0 END), 0e0), 6) AS recall_
FROM (SELECT f_.doc_id, lang, {_paper(d)} AS p FROM ({_features(d)}) AS f_) AS s JOIN {d.table('labels')} l ON l.doc_id = s.doc_id GROUP BY lang"""


@query
def score_doctype(d: Dialect) -> str:
    """Book, chapter, thesis and review by probability; the likeliest over one half, else an article."""
    c = lambda y, n, s: count_ratio("words", y, n, s)
    seen = lambda p, y, n: binary(d.hit("head", p), y, n)
    book = posterior(0.2, [c((7, 0.0001), (1, 0.0001), False)])
    chapter = posterior(0.2, [c((2, 0.0002), (3, 0.0002), True), binary("lower(source) LIKE '%chapter%'", 0.7, 0.05)])
    thesis = posterior(0.2, [c((7, 0.0001), (1, 0.0001), False), binary("lower(source) LIKE '%thesis%'", 0.7, 0.05)])
    review = posterior(0.15, [c((2, 0.0003), (3, 0.0002), True), seen(r"\breview", 0.6, 0.08), seen(r" Press\b", 0.6, 0.05), seen(r"\bhardcover", 0.4, 0.03), seen(r"[0-9 ]{12}", 0.4, 0.05), seen(r"\b[0-9]{3,4}( ?pp| pages)", 0.4, 0.04)])
    return f"""SELECT doc_id, round(book, 6) AS book, round(chapter, 6) AS chapter, round(thesis, 6) AS thesis, round(review, 6) AS review, CASE WHEN greatest(book, chapter, thesis, review) <= 0.5 THEN 'article' WHEN book >= greatest(chapter, thesis, review) THEN 'book' WHEN chapter >= greatest(thesis, review) THEN 'chapter' WHEN thesis >= review THEN 'thesis' ELSE 'review' END AS doctype
FROM (SELECT doc_id, {book} AS book, {chapter} AS chapter, {thesis} AS thesis, {review} AS review FROM ({_features(d)}) AS f_) AS q_"""


@query
def gate_ladder(d: Dialect) -> str:
    """What becomes of a document: dropped, hidden for review, shown without topics, or shown with them."""
    paper, topic = "CAST(floor(p * 100) AS INT)", "CASE WHEN l.quality IS NULL THEN 90 WHEN l.quality = 1 THEN 70 + CAST(s.doc_id % 30 AS INT) ELSE CAST(s.doc_id % 50 AS INT) END"
    return f"""SELECT doc_id, paper, topic, CASE WHEN paper < 25 OR topic < 25 THEN 'drop' WHEN paper < 60 OR topic < 60 THEN 'review' WHEN words <= 700 THEN 'show' ELSE 'categorise' END AS gate
FROM (SELECT s.doc_id, s.words, {paper} AS paper, {topic} AS topic FROM (SELECT *, {_paper(d)} AS p FROM ({_features(d)}) AS f_) AS s LEFT JOIN {d.table('labels')} l ON l.doc_id = s.doc_id) AS g_"""


@query
def dup_exact_md5(d: Dialect) -> str:
    """Each document with the first that has the same text."""
    return f"SELECT doc_id, h AS filehash, min(doc_id) OVER (PARTITION BY h) AS first_doc FROM (SELECT doc_id, md5(text) AS h FROM {d.table('documents')} WHERE text IS NOT NULL) AS h_"


def _shingles(d: Dialect, text: str) -> str:
    """Distinct words of four letters and more."""
    return d.distinct(d.extract_all(f"lower({text})", r"[\p{L}]{4,}", 0))


def _common(d: Dialect, a: str, b: str) -> str:
    return f"CAST({'len(list_intersect(' if d.duck else 'size(array_intersect('}{a}, {b})) AS DOUBLE)"


@query
def dup_blocked(d: Dialect) -> str:
    """Near copies within blocks: the same source and first long words, lengths within a fifth, and a similarity of words of 0.8.

    Of texts so alike each has nearly all words of the other, so the block is keyed by length too: a text is posted in its own
    band of lengths and in the next one, and openings that many texts share part into the lengths that they have."""
    opening = d.extract('lower(text)', '([\\p{L}]{4,}[^\\p{L}]+[\\p{L}]+[^\\p{L}]+[\\p{L}]+)')
    rows = f"SELECT doc_id, source, {opening} AS opening, n_chars, {_shingles(d, 'text')} AS w FROM {d.table('documents')} WHERE text IS NOT NULL"
    if d.duck:
        pairs = "SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.w AS wa, b.w AS wb FROM b a JOIN b b ON a.source = b.source AND a.opening = b.opening AND a.doc_id < b.doc_id AND abs(a.n_chars - b.n_chars) <= 0.2e0 * a.n_chars"
        return f"""WITH b AS ({rows}), p AS (SELECT doc_a, doc_b, {d.size('wa')} AS na, {d.size('wb')} AS nb, {_common(d, 'wa', 'wb')} AS c FROM ({pairs}) AS x_)
SELECT doc_a, doc_b, round(c / (na + nb - c), 6) AS similarity FROM p WHERE na + nb > 0 AND c / (na + nb - c) >= 0.8"""
    # Copies are one class, compared once. Lengths whose ratio is at most 1.25 lie in one band or in neighbours; two classes are met in the band of the shorter text.
    # Which of two lengths the fifth is of depends on which id is smaller, so that is judged for each pair of rows.
    band = "CAST(floor(ln(greatest(n_chars, 1)) / ln(1.25e0)) AS INT)"
    rows = rows.replace("n_chars,", "n_chars, md5(text) AS h,", 1)
    return f"""WITH b AS (SELECT source, opening, n_chars, h, any_value(w) AS w, collect_list(doc_id) AS ids, {band} AS band FROM ({rows}) AS r_ GROUP BY source, opening, n_chars, h),
p AS (SELECT a.ids AS ia, b.ids AS ib, a.n_chars AS la, b.n_chars AS lb, a.n_chars = b.n_chars AND a.h = b.h AS same, size(a.w) AS na, size(b.w) AS nb, {_common(d, 'a.w', 'b.w')} AS c
FROM b a JOIN (SELECT *, explode(array(band, band - 1, band - 2)) AS near FROM b) b ON a.source = b.source AND a.opening = b.opening AND a.band = b.near
AND (a.band < b.band OR struct(a.n_chars, a.h) <= struct(b.n_chars, b.h)) AND abs(a.n_chars - b.n_chars) <= 0.2e0 * greatest(a.n_chars, b.n_chars)),
q AS (SELECT ia, ib, la, lb, same, round(c / (na + nb - c), 6) AS similarity FROM p WHERE na + nb > 0 AND c / (na + nb - c) >= 0.8)
SELECT least(x, y) AS doc_a, greatest(x, y) AS doc_b, similarity FROM q LATERAL VIEW explode(ia) x_ AS x LATERAL VIEW explode(ib) y_ AS y
WHERE (x < y OR (NOT same AND x > y)) AND abs(la - lb) <= 0.2e0 * CASE WHEN x < y THEN la ELSE lb END"""


@query
def dup_revision(d: Dialect) -> str:
    """Documents of a source with the same first line, each against the one before: under 0.8 similar words it is a substantive revision."""
    title = d.extract("text", f"^([^{chr(10)}]*)")
    rows = f"SELECT doc_id, source, {title} AS title, {_shingles(d, 'text')} AS w FROM {d.table('documents')} WHERE text IS NOT NULL"
    return f"""SELECT doc_id, earlier_id, round(c / greatest(n - c, 1e0), 6) AS ratio, c / greatest(n - c, 1e0) < 0.8 AS substantive FROM (SELECT doc_id, earlier_id, CAST({d.size('w')} + {d.size('before')} AS DOUBLE) AS n, {_common(d, 'w', 'before')} AS c
FROM (SELECT *, lag(doc_id) OVER (PARTITION BY source, title ORDER BY doc_id) AS earlier_id, lag(w) OVER (PARTITION BY source, title ORDER BY doc_id) AS before FROM ({rows}) AS r_) AS l_ WHERE earlier_id IS NOT NULL) AS c_"""


@query
def known_item_contains(d: Dialect) -> str:
    """Documents that hold a known text, by folded words, which is plain containment: a text of eight words and more is joined on a
    hash of its second to seventh, which are whole words wherever it is held, and then compared whole; shorter ones are compared
    with every document. Texts without a word aren't known ones. The SQL for DuckDB compares all with all."""
    fold = lambda c: d.replace(d.fold(c), r"[^\p{L}\p{N}]+", " ")
    if d.duck:
        return f"""SELECT DISTINCT t.doc_id, k.item_id FROM (SELECT doc_id, {fold('text')} AS f FROM documents WHERE text IS NOT NULL) t
JOIN (SELECT item_id, trim({fold('text')}) AS t FROM benchmark WHERE text IS NOT NULL) k ON k.t <> '' AND contains(t.f, k.t)"""
    words = lambda c: d.split(f"trim({fold(c)})", " ")
    gram = "xxhash64(" + ", ".join(f"get(w, i + {k})" for k in range(6)) + ")"
    docs = d.once(f"(SELECT doc_id, text FROM {d.table('documents')} WHERE text IS NOT NULL) AS d_", words("text"), "w")
    posted = f"(SELECT doc_id, CASE WHEN size(w) >= 6 THEN transform(sequence(0, size(w) - 6), i -> {gram}) END AS g FROM {docs}) AS g_"
    known = f"SELECT item_id, trim({fold('text')}) AS t, {words('text')} AS w FROM {d.table('benchmark')} WHERE text IS NOT NULL"
    folded = d.once(f"(SELECT doc_id, text FROM {d.table('documents')} WHERE text IS NOT NULL) AS t_", fold("text"), "f")
    return f"""WITH k AS (SELECT item_id, t, size(w) AS n, {gram.replace('i + ', '1 + ')} AS g1 FROM (SELECT * FROM ({known}) AS a_ WHERE t <> '') AS b_),
c AS (SELECT DISTINCT p.doc_id, k.item_id FROM (SELECT doc_id, gram FROM {d.explode(posted, 'g', 'gram')}) p JOIN k ON k.n >= 8 AND k.g1 = p.gram)
SELECT DISTINCT c.doc_id, c.item_id FROM c JOIN k ON k.n >= 8 AND k.item_id <=> c.item_id JOIN {d.table('documents')} t ON t.doc_id <=> c.doc_id WHERE contains({fold('t.text')}, k.t)
UNION SELECT f.doc_id, k.item_id FROM (SELECT doc_id, f FROM {folded}) f JOIN (SELECT item_id, t FROM k WHERE n < 8) k ON contains(f.f, k.t)"""


@query
def fuzzy_levenshtein(d: Dialect) -> str:
    """Names of parts of the same type that differ by up to a fifth of their letters."""
    far = "levenshtein(a.name, b.name)"
    return f"""SELECT a.name AS name_a, b.name AS name_b, CAST({far} AS INT) AS distance FROM (SELECT DISTINCT p_name AS name, p_type FROM {d.table('part')}) a JOIN (SELECT DISTINCT p_name AS name, p_type FROM {d.table('part')}) b
ON a.p_type = b.p_type AND a.name < b.name WHERE {far} <= ceil(0.2 * length(a.name)) GROUP BY a.name, b.name, {far}"""


@query
def tfidf_terms(d: Dialect) -> str:
    """For each language and term in at least two documents: document frequency and smoothed inverse frequency."""
    rows = f"(SELECT doc_id, lang, {_shingles(d, 'text')} AS w FROM {d.table('documents')} WHERE text IS NOT NULL) AS w_"
    return f"""SELECT t.lang, term, df, round(ln((1e0 + n) / (1e0 + df)) + 1e0, 6) AS idf FROM (SELECT lang, term, count(*) AS df FROM {d.explode(rows, 'w', 'term')} GROUP BY lang, term HAVING count(*) > 1) t
JOIN (SELECT lang, count(*) AS n FROM {d.table('documents')} WHERE text IS NOT NULL GROUP BY lang) n_ ON n_.lang = t.lang"""
