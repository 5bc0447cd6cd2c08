"""Pages, their addresses and their links."""

from __future__ import annotations

from lectio.functions.dialect import Dialect
from lectio.functions.score import binary, ladder, posterior
from lectio.plans.registry import query

MEDIA = "jpg|jpeg|png|gif|mp3|mp4|avi|mov|zip|css|js"
BLOCKED = "facebook.|twitter.|linkedin.|youtube."
BLACKLIST = "wikipedia.org|amazon.|google.|books.|jstor.|/calendar|/search|/archive|/tag/|/login|/cart|ref=|facebook.|twitter.|linkedin.|youtube.|instagram.|reddit.|quora.|goodreads.|barnesandnoble.|abebooks.|springer.|wiley.|tandfonline.|sagepub.|elsevier.|sciencedirect.|oup.com|cambridge.org|degruyter.|muse.jhu|projecteuclid.|bepress.|scribd.|slideshare.|docstoc.|issuu.|coursera.|edx.org|ratemyprofessors.|news.|/news/|/press/|/events/|/course|/courses/|/syllabus|/teaching/|/jobs|/careers|/donate|/shop|/store/|/forum|/wiki/|/feed|/rss|/category/|/print/|/gallery|/photos|/video"


def url_key_sql(d: Dialect, url: str) -> str:
    """What variants of an address have in common: no scheme, www, fragment, or last slash, and lower case."""
    return f"lower({d.replace(d.replace(d.replace(url, '#.*$', ''), '^https?://(www[.])?', ''), '/$', '')})"


def normal_sql(d: Dialect, url: str) -> str:
    """An address without its fragment, with spaces and quotes percent-encoded."""
    return f"replace(replace({d.replace(url, '#.*$', '')}, ' ', '%20'), '\"', '%22')"


def absolute_sql(d: Dialect, base: str, href: str) -> str:
    """A link against the page's address: with a scheme as it is, else by scheme, host, query or folder."""
    scheme, host = d.extract(base, "^(https?:)"), d.extract(base, "^(https?://[^/?#]+)")
    page, folder = d.extract(base, "^([^?#]*)"), d.extract(base, "^(https?://[^/?#]+(?:/[^?#]*/|/)?)")
    folder = f"(CASE WHEN {d.hit(folder, '/$')} AND length({folder}) > 8 THEN {folder} ELSE concat({host}, '/') END)"
    return f"CASE WHEN {d.hit(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:')} THEN {href} WHEN {href} LIKE '//%' THEN concat({scheme}, {href}) WHEN {href} LIKE '/%' THEN concat({host}, {href}) WHEN {href} LIKE '?%' OR {href} LIKE '#%' THEN concat({page}, {href}) ELSE concat({folder}, {href}) END"


def strip_tags_sql(d: Dialect, html: str) -> str:
    """The text of markup: scripts, styles and comments go with what they hold, tags become spaces, spaces are squeezed."""
    text = html
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[a-zA-Z/!?][^>]*>"):
        text = d.replace(text, pattern, " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{sign}')"
    text = d.replace(text, r"[ \t\r\n]+", " ")
    for mark in (".", ",", ";", ":", ")"):
        text = f"replace({text}, ' {mark}', '{mark}')"
    return f"trim({text})"


def _links(d: Dialect) -> str:
    """Each page's links once, with the absolute address."""
    rows = f"(SELECT page_id, url, {d.extract_all('html', '(?i)<a [^>]*href=.([^> ]+?).(?: [^>]*)?>')} AS hrefs FROM {d.table('pages')})"
    return f"SELECT DISTINCT page_id, url, href, {absolute_sql(d, 'url', 'href')} AS link FROM {d.explode(rows + ' AS p_', 'hrefs', 'href')}"


@query
def url_key(d: Dialect) -> str:
    return f"SELECT page_id, {url_key_sql(d, 'url')} AS url_key, md5(url) AS urlhash FROM {d.table('pages')}"


@query
def url_normalize(d: Dialect) -> str:
    return f"SELECT page_id, {normal_sql(d, 'url')} AS url FROM {d.table('pages')}"


@query
def url_blacklist(d: Dialect) -> str:
    """Addresses that can't be sources: too long, a PDF, or with a listed part."""
    part = d.hit("lower(url)", BLACKLIST.replace(".", "[.]"))
    return f"SELECT page_id, length(url) > 255 OR lower(url) LIKE '%.pdf' OR {part} AS blacklisted FROM {d.table('pages')}"


@query
def url_absolute(d: Dialect) -> str:
    return f"SELECT page_id, href, link FROM ({_links(d)}) AS l_"


@query
def url_strip_session(d: Dialect) -> str:
    return f"SELECT page_id, {d.replace('url', '(?i)(ref|sid|session|phpsessid)=[^&;#]*', '')} AS url FROM {d.table('pages')}"


@query
def page_links(d: Dialect) -> str:
    """Links that are kept: web addresses of some length that lead elsewhere, no media, no blocked host, no search page."""
    path = d.extract("link", "^https?://[^/?#]+(/[^?#]*)")
    return f"""SELECT page_id, href, link FROM ({_links(d)}) AS l_ WHERE link LIKE 'http%' AND link LIKE '%//%' AND length(link) < 512 AND {normal_sql(d, 'link')} <> {normal_sql(d, 'url')} AND length({path}) > 1
AND NOT {d.hit(f'lower({path})', f'[.]({MEDIA})$')} AND NOT {d.hit("lower(link)", f"//[^/]*({BLOCKED.replace('.', '[.]')})")} AND NOT {d.hit('link', '[?&](q|query|search)=')}"""


@query
def page_links_new_vs_known(d: Dialect) -> str:
    """Links of every page against those of earlier pages of the same language, as known links: by address, then by key, then without session variables; the first tier that matches counts."""
    sess = lambda c: d.replace(url_key_sql(d, c), "[?&;](ref|sid|page)=[^&;#]*", "")
    links = f"SELECT page_id, link, {d.extract('url', '/([a-z][a-z])/')} AS area, {d.extract('link', '(/[^/]*)$')} AS tail FROM ({_links(d)}) AS l_"
    tiers = f"SELECT page_id, link, area, tail, {url_key_sql(d, 'tail')} AS k, {sess('tail')} AS s FROM ({links}) AS t_"
    first = lambda c: f"min(page_id) OVER (PARTITION BY area, {c}) < page_id"
    return f"SELECT page_id, link, CASE WHEN {first('tail')} THEN 1 WHEN {first('k')} THEN 2 WHEN {first('s')} THEN 3 ELSE 0 END AS tier FROM ({tiers}) AS k_"


@query
def page_strip_tags(d: Dialect) -> str:
    return f"SELECT page_id, {strip_tags_sql(d, 'html')} AS text FROM {d.table('pages')}"


@query
def page_title_h1(d: Dialect) -> str:
    """Title and first heading; an encyclopedia entry takes its title from the heading, and pages from its words."""
    return f"""SELECT page_id, {strip_tags_sql(d, d.extract('html', '(?is)<title>(.*?)</title>'))} AS title, {strip_tags_sql(d, d.extract('html', '(?is)<h1[^>]*>(.*?)</h1>'))} AS h1, {d.count('html', '(?i)<p[ >]')} AS paragraphs FROM {d.table('pages')}"""


@query
def page_boilerplate_trim(d: Dialect) -> str:
    """Paragraphs of the article: from the first of some length on, without those after which only comments follow."""
    rows = f"(SELECT page_id, {d.extract_all('html', '(?is)<p>(.*?)</p>')} AS parts FROM {d.table('pages')}) AS p_"
    text = strip_tags_sql(d, "part")
    return f"""SELECT page_id, place, text FROM (SELECT *, sum(CASE WHEN length(text) > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS begun,
max(CASE WHEN {d.hit('text', '(?i)^(posted by|reply|[0-9]+ comments?)')} THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended
FROM (SELECT page_id, place, {text} AS text FROM {d.posexplode(rows, 'parts', 'place', 'part')}) AS t_) AS w_ WHERE begun > 0 AND ended = 0"""


def _page(d: Dialect) -> str:
    return f"SELECT page_id, url, lower(html) AS html, {strip_tags_sql(d, 'html')} AS text, {d.size(d.extract_all('html', '(?i)href=.[^> ]+[.](pdf|docx?)'))} AS docs FROM {d.table('pages')}"


@query
def score_dead(d: Dialect) -> str:
    """Probability that a page is dead, by length, documents, status words and messages of absence."""
    ratios = [binary("length(text) < 500", 0.9, 0.2), binary("docs = 0", 0.9, 0.3), binary(f"NOT {d.hit('lower(text)', 'forthcoming|draft|manuscript|submitted')}", 0.9, 0.2), binary(d.hit("lower(text)", "not found|404|no longer"), 0.7, 0.1)]
    return f"SELECT page_id, round(p, 6) AS p_dead, p > 0.8 AS dead FROM (SELECT page_id, {posterior(0.5, ratios)} AS p FROM ({_page(d)}) AS p_) AS q_"


@query
def score_source(d: Dialect) -> str:
    """Probability that a page lists someone's papers, by its links, words and address."""
    word = lambda p: d.count("html", p)
    tables = [
        ("docs", [(0, 0.15, 0.7), (1, 0.25, 0.8), (3, 0.35, 0.88), (10, 0.6, 0.91), (100, 0.98, 0.95)]),
        (word("forthcoming|draft|manuscript|in press"), [(0, 0.3, 0.8), (1, 0.4, 0.86), (2, 0.5, 0.9)]),
        (word("syllabus|office hours|grading"), [(0, 0.95, 0.7), (1, 0.97, 0.8)]),
        (word("abstract|introduction"), [(0, 0.94, 0.8), (1, 0.98, 0.9)]),
        ("length(url)", [(50, 0.85, 0.7), (100, 0.94, 0.82), (150, 0.98, 0.92)]),
        (word("posted by|comments?|archives"), [(0, 0.9, 0.7), (3, 0.95, 0.8), (7, 0.98, 0.88)]),
        (word("add to cart|checkout|shipping|price"), [(0, 0.9, 0.3), (2, 0.95, 0.6)]),
    ]
    ratios = [*(ladder(v, t) for v, t in tables), binary(f"{word('conference')} > 2", 0.01, 0.2), binary(d.hit("url", "/[0-9]{4}/[0-9]{2}/"), 0.01, 0.1), binary(d.hit("url", "[?&](q|query|search)="), 0.03, 0.12)]
    return f"SELECT page_id, round(p, 6) AS p_source, p >= 0.75 AS add_source FROM (SELECT page_id, {posterior(0.6, ratios)} AS p FROM ({_page(d)}) AS p_) AS q_"


@query
def dup_url_key(d: Dialect) -> str:
    """Pages whose addresses are variants of one another once parameters are gone."""
    key = d.replace(url_key_sql(d, "url"), "(/[0-9]+)?/?([?].*)?$", "")
    rows = f"SELECT page_id, {key} AS k FROM {d.table('pages')}"
    return f"SELECT page_id, k AS url_key, min(page_id) OVER (PARTITION BY k) AS first_page, CAST(count(*) OVER (PARTITION BY k) AS INT) AS n FROM ({rows}) AS r_"
