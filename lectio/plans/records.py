"""Lookups, upserts, gates and connectors over derived state, each beside SQL of its own for DuckDB.

Where a plan parses text, the text is put together from columns first, and its SQL reads those columns: what comes out of the
parser has to be what went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectio.operators import pairs
from lectio.plans.registry import Tables, paired
from lectio.plans.relational import NOW

BIB_MARK = "@@"
#: What a page may call the state of a text that isn't published, and what tells that it is.
FORTHCOMING = "forthcoming|unpublished|to appear"
PUBLISHED = r"(^|\n)in: |journal of |vol\. ?[0-9]+|pp?\. ?[0-9]+|university press|proceedings of "
#: Addresses of repositories with the document's own address in place of that of its page.
REPOSITORIES = (
    (r"^https?://(?:www\.)?dropbox\.com/(.+?)(?:\?dl=0)?$", "https://dl.dropboxusercontent.com/$1"),
    (r"^https?://arxiv\.org/abs/(.+)$", "https://arxiv.org/pdf/$1.pdf"),
    (r"^https?://philpapers\.org/rec/([A-Z0-9-]+)$", "https://philpapers.org/archive/$1.pdf"),
    (r"^https?://([^/]+)/eprint/([0-9]+)/?$", "https://$1/$2/1/document.pdf"),
    (r"^https?://([^/]+)/handle/([0-9]+)/([0-9]+)$", "https://$1/bitstream/$2/$3/1/text.pdf"),
    (r"^https?://hal\.science/(hal-[0-9]+)$", "https://hal.science/$1/document"),
    (r"^https?://osf\.io/([a-z0-9]{5})/?$", "https://osf.io/$1/download"),
)


def first_line(c: str = "text") -> str:
    return f"substring_index({c}, '\n', 1)"


@paired("""SELECT doc_id, EXISTS (SELECT 1 FROM documents p JOIN labels l ON l.doc_id = p.doc_id WHERE l.quality = 1 AND p.source = d.source AND lower(trim(split_part(p.text, chr(10), 1))) = lower(trim(split_part(d.text, chr(10), 1)))) AS published
FROM documents d WHERE text IS NOT NULL""")
def published_check(t: Tables) -> DataFrame:
    """Whether a publication with a document's title, in any case, by the same author (here its source) is known; publications are the documents that were judged good."""
    docs = t("documents", "doc_id", "source", "text").where("text IS NOT NULL").selectExpr("doc_id", "source", f"lower(trim({first_line()})) AS title")
    known = docs.join(t("labels", "doc_id", "quality").where("quality = 1"), "doc_id", "left_semi").select("source", "title", F.lit(True).alias("hit")).distinct()
    return docs.join(known, ["source", "title"], "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("published"))


@paired("""SELECT doc_id, min(doc_id) OVER (PARTITION BY source) AS cat_id, source NOT IN ('src0', 'src1') AS topical FROM documents""")
def category_lookup(t: Tables) -> DataFrame:
    """The id of each document's category by its label, and whether it is one of the topical ones."""
    docs = t("documents", "doc_id", "source")
    cats = docs.groupBy(F.col("source").alias("label")).agg(F.min("doc_id").alias("cat_id"))
    return docs.join(cats, F.col("source").eqNullSafe(F.col("label"))).select("doc_id", "cat_id", (~F.col("source").isin("src0", "src1")).alias("topical"))


@paired("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations) WHERE place = 1 AND role = 'user'""")
def blog_inbox(t: Tables) -> DataFrame:
    """Posts that nothing has been done with: last turns that wait for an answer."""
    last = t("conversations", "conv_id", "turn", "role").groupBy("conv_id").agg(F.max(F.struct("turn", "role")).alias("m"))
    return last.where("m.role = 'user'").select("conv_id", "m.turn")


@paired("""SELECT doc_id, lang FROM documents WHERE NOT coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false)""")
def reject_posts(t: Tables) -> DataFrame:
    """What is left when rejected documents are deleted."""
    return t("documents", "doc_id", "lang").join(t("labels", "doc_id", "toxic").where("toxic = 1"), "doc_id", "left_anti")


@paired("""SELECT p_brand AS author, string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS titles, count(DISTINCT p_name) AS n FROM part GROUP BY p_brand""")
def known_titles(t: Tables) -> DataFrame:
    """The known titles of each author, in order."""
    rows = t("part", "p_brand", "p_name").distinct()
    return rows.groupBy(F.col("p_brand").alias("author")).agg(F.array_join(F.array_sort(F.collect_list("p_name")), "; ").alias("titles"), F.count("p_name").alias("n"))


@paired("""SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type, props) AS link_id FROM events""")
def composite_key_lookup(t: Tables) -> DataFrame:
    """The link of a request by the hash of its address and its source."""
    rows = t("events", "event_id", "user_id", "event_type", "props").select("event_id", F.col("user_id").alias("source_id"), F.md5(F.concat_ws("/", "event_type", "props")).alias("urlhash"))
    links = rows.groupBy("source_id", "urlhash").agg(F.min("event_id").alias("link_id"))
    return rows.join(links, ["source_id", "urlhash"]).select("event_id", "link_id")


@paired("""SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN n_chars < 200 THEN 'u' || source || '/' || doc_id ELSE 'f' || text END) AS earlier_id FROM documents WHERE text IS NOT NULL""")
def load_by_hash(t: Tables) -> DataFrame:
    """The first document with the same hash: that of the file, else (for tiny files, which are alike by chance) that of the address."""
    key = F.coalesce(F.when(F.col("n_chars") >= 200, F.concat(F.lit("f"), F.md5("text"))), F.concat(F.lit("u"), F.md5(F.concat_ws("/", "source", "doc_id"))))
    rows = t("documents").where("text IS NOT NULL").select("doc_id", key.alias("key"))
    return rows.join(rows.groupBy("key").agg(F.min("doc_id").alias("earlier_id")), "key").select("doc_id", "earlier_id")


@paired(r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')[1:8] AS w FROM benchmark WHERE text IS NOT NULL)
SELECT d.doc_id, k.item_id, len(list_intersect(list_distinct(k.w), d.w)) AS common FROM d JOIN k ON len(k.w) >= 3 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || k.w[2] || ' ' || k.w[3] || ' ') AND len(list_intersect(list_distinct(k.w), d.w)) >= 0.8e0 * len(list_distinct(k.w))""")
def known_work(t: Tables) -> DataFrame:
    """Documents that cite a known work: blocked on two consecutive words of its title (its first eight words), and the same work if four fifths of them occur."""
    words = lambda c: F.expr(f"filter(split(lower({c}), '[^\\\\p{{L}}\\\\p{{N}}]+', -1), x -> x <> '')")
    docs = t("documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.explode(F.array(words("text"))).alias("w"))
    pairs = docs.where("size(w) > 1").select("doc_id", F.explode(F.expr("transform(sequence(0, size(w) - 2), i -> xxhash64(get(w, i), get(w, i + 1)))")).alias("pair"))
    known = t("benchmark", "item_id", "text").where("text IS NOT NULL").select("item_id", F.slice(words("text"), 1, 8).alias("k")).where("size(k) >= 3").select("item_id", "k", F.expr("xxhash64(k[1], k[2])").alias("pair"))
    found = pairs.join(known, "pair").select("doc_id", "item_id").distinct()
    both = found.join(docs, "doc_id").join(known.select("item_id", "k"), "item_id")
    held = "contains(concat(' ', array_join(w, ' '), ' '), concat(' ', k[1], ' ', k[2], ' '))"
    return both.where(held).selectExpr("doc_id", "item_id", "size(array_intersect(k, w)) AS common", "size(array_distinct(k)) AS n").where("common >= 0.8e0 * n").select("doc_id", "item_id", F.col("common").cast("long").alias("common"))


@paired(f"""WITH s AS (SELECT c_custkey, c_name, coalesce(max(epoch_us(o_orderdate)), 0) AS searched FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY searched, c_name) <= 20 THEN epoch_us({NOW}) ELSE searched END AS searched FROM s""")
def mark_searched(t: Tables) -> DataFrame:
    """Names with their last search, after the twenty least recent were searched just now."""
    last = t("orders", "o_custkey", "o_orderdate").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("m"))
    names = t("customer", "c_custkey", "c_name").join(last, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("m", F.lit(0)).alias("was"))
    now = names.orderBy("was", "c_name").limit(20).select("c_custkey", F.expr(f"unix_micros({NOW})").alias("now"))
    return names.join(F.broadcast(now), "c_custkey", "left").select("c_custkey", F.coalesce("now", "was").alias("searched"))


@paired(f"""WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS e, max(ts) AS ts FROM events GROUP BY user_id)
SELECT page_id, CASE WHEN s.user_id IS NULL THEN 'insert' WHEN e = 'error' AND ts < {NOW} - INTERVAL 15 DAY THEN 'revive' WHEN e = 'error' THEN 'ignore' WHEN e = 'signup' THEN 'wait' ELSE 'known' END AS action FROM pages LEFT JOIN s ON s.user_id = page_id""")
def known_url_lifecycle(t: Tables) -> DataFrame:
    """What becomes of an address that was found: inserted if unknown, revived if it was given up long ago, else left."""
    last = t("events", "event_id", "user_id", "event_type", "ts").groupBy(F.col("user_id").alias("page_id")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    old = F.expr(f"unix_micros(CAST(m.ts AS TIMESTAMP)) < unix_micros({NOW}) - 15L * 86400000000")
    action = F.when(F.col("m").isNull(), "insert").when(F.col("m.event_type") == "error", F.when(old, "revive").otherwise("ignore")).when(F.col("m.event_type") == "signup", "wait").otherwise("known")
    return t("pages", "page_id").join(last, "page_id", "left").select("page_id", action.alias("action"))


@paired("""SELECT lang, min(page_id) AS page_id FROM pages, (VALUES ('en'), ('de'), ('fr'), ('es')) AS v(lang) WHERE instr(url, '/' || lang || '/') > 0 GROUP BY lang""")
def source_contains(t: Tables) -> DataFrame:
    """The first source whose address has a part, for each of some parts."""
    part = F.explode(F.filter(F.array(*map(F.lit, ("en", "de", "fr", "es"))), lambda x: F.contains(F.col("url"), F.concat(F.lit("/"), x, F.lit("/")))))
    return t("pages", "page_id", "url").select("page_id", part.alias("lang")).groupBy("lang").agg(F.min("page_id").alias("page_id"))


@paired("""SELECT p_brand AS author, p_name AS title, min(p_size) AS year FROM part GROUP BY ALL""")
def append_publications(t: Tables) -> DataFrame:
    """Publications after those of a search are added: of each author and title one, with its first year. Here the small parts are known and all are found."""
    found = t("part", "p_brand", "p_name", "p_size", "p_type").toDF("author", "title", "year", "kind")
    known = found.where("kind = 'SMALL'").groupBy("author", "title").agg(F.min("year").alias("known"))
    new = found.groupBy("author", "title").agg(F.min("year").alias("year"))
    return known.join(new, ["author", "title"], "full").select("author", "title", F.least("known", "year").alias("year"))


@paired("""SELECT doc_id, CASE WHEN quality IS NULL THEN 50 ELSE quality * 100 END AS strength, quality IS NOT NULL AS is_training FROM documents LEFT JOIN labels USING (doc_id)""")
def upsert_strength(t: Tables) -> DataFrame:
    """The strength of each document in a category: a judgement replaces what was computed, and trains."""
    old = t("documents", "doc_id").select("doc_id", F.lit(50).alias("old"))
    new = t("labels", "doc_id", "quality").select("doc_id", (F.col("quality") * 100).alias("new"))
    return old.join(new, "doc_id", "left").select("doc_id", F.coalesce("new", "old").alias("strength"), F.col("new").isNotNull().alias("is_training"))


@paired("""SELECT e.event_id, EXISTS (SELECT 1 FROM events b WHERE b.event_id = (SELECT max(event_id) FROM events c WHERE c.user_id = e.user_id AND c.event_id < e.event_id) AND (b.props = e.props OR floor(b.value) = floor(e.value))) AS unchanged FROM events e""")
def conditional_get(t: Tables) -> DataFrame:
    """Whether a page is unchanged since the visit before: the same tag (props) or the same length (whole value)."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    same = (F.lag("props").over(w) == F.col("props")) | (F.floor(F.lag("value").over(w)) == F.floor("value"))
    return t("events", "event_id", "user_id", "props", "value").select("event_id", F.coalesce(same, F.lit(False)).alias("unchanged"))


@paired("""SELECT p_partkey, p_name AS title, p_size AS pages, p_brand AS producer, CAST(NULL AS VARCHAR) AS author FROM part""")
def pdf_metadata(t: Tables) -> DataFrame:
    """Lines of "key: value" as a map: title, pages and producer, and an author, which these haven't."""
    lines = F.concat(F.lit("Title:          "), "p_name", F.lit("\nPages:  "), F.col("p_size").cast("string"), F.lit("\nProducer: "), "p_brand")
    row = t("part", "p_partkey", "p_name", "p_size", "p_brand").select("p_partkey", F.str_to_map(lines, F.lit("\n"), F.lit(":")).alias("m"))
    value = lambda k: F.trim(F.try_element_at("m", F.lit(k)))
    return row.select("p_partkey", value("Title").alias("title"), value("Pages").cast("int").alias("pages"), value("Producer").alias("producer"), value("Author").alias("author"))


@paired("""WITH p AS (SELECT doc_id, CAST(greatest(1, ceil(n_chars / 500e0)) AS BIGINT) AS n FROM documents)
SELECT doc_id, n AS pages, CASE WHEN n < 5 THEN array_to_string(range(1, n + 1), ',') WHEN n < 50 THEN '1,2,3,4' ELSE '1,2,3,4,20,21,22,23' END AS read, CASE WHEN n <= 6 THEN array_to_string(range(1, n + 1), ',') ELSE '1,2,3,' || (n - 2) || ',' || (n - 1) || ',' || n END AS ocr FROM p""")
def page_ranges(t: Tables) -> DataFrame:
    """The pages of a document that are read, and those that are recognised where it is scanned; here a page has 500 characters."""
    pages = t("documents", "doc_id", "n_chars").selectExpr("doc_id", "CAST(greatest(1, ceil(n_chars / 500e0)) AS BIGINT) AS pages")
    read = "CASE WHEN pages < 5 THEN true WHEN pages < 50 THEN i BETWEEN 1 AND 4 ELSE i BETWEEN 1 AND 4 OR i BETWEEN 20 AND 23 END"
    some = lambda c: f"array_join(filter(sequence(1L, pages), i -> {c}), ',')"
    return pages.selectExpr("doc_id", "pages", f"{some(read)} AS read", f"{some('i <= 3 OR i >= pages - 2')} AS ocr")


@paired("""SELECT doc_id, to_json({'doc_id': doc_id, 'title': split_part(text, chr(10), 1), 'numpages': CAST(ceil(n_chars / 2000e0) AS BIGINT), 'authors': [source, lang]}) AS result FROM documents WHERE text IS NOT NULL""")
def json_result(t: Tables) -> DataFrame:
    """The result of an extraction as one line of JSON."""
    row = F.struct("doc_id", F.expr(first_line()).alias("title"), F.ceil(F.col("n_chars") / 2000).alias("numpages"), F.array("source", "lang").alias("authors"))
    return t("documents").where("text IS NOT NULL").select("doc_id", F.to_json(row).alias("result"))


@paired("""SELECT p_partkey, 0 AS place, p_name AS title, p_brand AS authors, 1950 + p_size AS year FROM part UNION ALL SELECT p_partkey, 1, 'On ' || p_type, p_brand || '; Smith, J.', NULL FROM part""")
def bib_records(t: Tables) -> DataFrame:
    """Records of a bibliographic search, parted by a mark: title (255 characters at most, no full stop at its end), authors, and a year where it is a number."""
    text = F.concat(F.lit(f"{BIB_MARK}\nT: "), "p_name", F.lit(".\nA: "), "p_brand", F.lit("\nY: "), (F.col("p_size") + 1950).cast("string"), F.lit(f"\n{BIB_MARK}\nT: On "), "p_type", F.lit("\nA: "), "p_brand", F.lit("; Smith, J.\nY: forthcoming\n"))
    records = t("part", "p_partkey", "p_name", "p_brand", "p_size", "p_type").select("p_partkey", text.alias("text")).select("p_partkey", F.posexplode(F.expr(f"filter(split(text, '{BIB_MARK}\n'), x -> trim(x) <> '')")).alias("place", "r"))
    field = lambda k: F.regexp_extract("r", f"(?m)^{k}: (.*)$", 1)
    title = F.regexp_replace(field("T"), r"\.$", "")
    return records.select("p_partkey", "place", F.when(F.length(title) > 255, F.concat(F.substring(title, 1, 251), F.lit("..."))).otherwise(title).alias("title"), field("A").alias("authors"), F.when(field("Y").rlike("^[0-9]{4}$"), field("Y").cast("int")).alias("year"))


@paired("""SELECT p_partkey, 'https://scholar.example.org/scholar?' || 'as_q=' || replace(p_name, ' ', '%20') || '&as_epq=%22' || replace(p_brand, '#', '%23') || '%22' || CASE WHEN p_size % 2 = 0 THEN '&as_sauthors=' || lower(p_type) ELSE '' END || '&as_ylo=' || (1950 + p_size) AS url FROM part""")
def scholar_query(t: Tables) -> DataFrame:
    """The address of a search by words, phrase, author and year; parts that aren't given are left out."""
    quoted = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    field = lambda k, v: F.concat(F.lit(f"{k}="), quoted(v))
    author = F.when(F.col("p_size") % 2 == 0, F.lower("p_type"))
    query = F.concat_ws("&", field("as_q", F.col("p_name")), field("as_epq", F.concat(F.lit('"'), "p_brand", F.lit('"'))), field("as_sauthors", author), field("as_ylo", (F.col("p_size") + 1950).cast("string")))
    return t("part", "p_partkey", "p_name", "p_brand", "p_size", "p_type").select("p_partkey", F.concat(F.lit("https://scholar.example.org/scholar?"), query).alias("url"))


@paired("""SELECT c_nationkey, c_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE i // CAST(ceil(n / 7e0) AS INT) = 5""")
def feed_names(t: Tables) -> DataFrame:
    """Names on a page that are looked up on one weekday: a seventh of them each day, here for Saturday, the fifth from Monday as 0."""
    html = F.concat(F.lit("<li><span class='name'>"), "c_name", F.lit("</span></li><li class='none'>"), "c_mktsegment", F.lit("</li>"))
    names = t("customer", "c_custkey", "c_nationkey", "c_name", "c_mktsegment").select("c_custkey", "c_nationkey", F.explode(F.regexp_extract_all(html, F.lit("class='name'>([^<]*)<"), F.lit(1))).alias("name"))
    w = Window.partitionBy("c_nationkey")
    day = F.expr(f"weekday({NOW})")
    placed = names.select("c_nationkey", "name", (F.row_number().over(w.orderBy("c_custkey")) - 1).alias("i"), F.ceil(F.count("name").over(w) / 7).alias("share"))
    return placed.where(F.floor(F.col("i") / F.col("share")) == day).select("c_nationkey", "name")


@paired("""WITH p AS (SELECT conv_id, turn, length(text) AS n, (conv_id * 37 + turn * 11) % 100 AS phil, len(list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '')) AS words FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN NOT (n >= 500 AND phil >= 5) THEN 'drop' WHEN phil < 40 THEN 'hidden' WHEN words > 700 THEN 'categorise' ELSE 'show' END AS gate FROM p""")
def blog_gates(t: Tables) -> DataFrame:
    """What becomes of a post: dropped if it is short or off topic, hidden if that is doubtful, else shown, and put in categories if it is long. The topic's score stands in for a trained one."""
    row = t("conversations", "conv_id", "turn", "text").where("text IS NOT NULL").selectExpr("conv_id", "turn", "length(text) AS n", "pmod(conv_id * 37 + turn * 11, 100) AS phil", "regexp_count(text, '[^ \t\r\n]+') AS words")
    return row.selectExpr("conv_id", "turn", "CASE WHEN n < 500 THEN 'drop' WHEN phil < 5 THEN 'drop' WHEN phil < 40 THEN 'hidden' WHEN words > 700 THEN 'categorise' ELSE 'show' END AS gate")


@paired("""SELECT p_partkey, p_size % 6 IN (1, 2, 4) AND p_partkey % 2 = 0 AS published FROM part""")
def published_context(t: Tables) -> DataFrame:
    """Whether what stands around a link tells that the text is published: no word that it isn't yet, a year from 1951 to now, and one of six patterns of a publication."""
    where = "CASE p_size % 6 WHEN 0 THEN 'A draft of ' WHEN 1 THEN 'In: Papers on ' WHEN 2 THEN 'Journal of Things, Vol. 3, ' WHEN 3 THEN 'Forthcoming in Journal of ' WHEN 4 THEN 'Oxford University Press, ' ELSE 'Notes, to appear, pp. 3-9, ' END"
    year = "CASE p_partkey % 4 WHEN 0 THEN '1999' WHEN 2 THEN '(2021)' WHEN 1 THEN '1950' ELSE '2099' END"
    row = t("part", "p_partkey", "p_name", "p_size").selectExpr("p_partkey", f"concat({where}, p_name, ' ', {year}) AS c")
    dated = F.exists(F.regexp_extract_all("c", F.lit("([0-9]{4})"), F.lit(1)), lambda y: (y.cast("int") > 1950) & (y.cast("int") <= F.year(F.expr(NOW))))
    return row.select("p_partkey", (~F.col("c").rlike(f"(?i){FORTHCOMING}") & dated & F.col("c").rlike(f"(?i){PUBLISHED}")).alias("published"))


@paired("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Default Author' WHEN 1 THEN 'John Smith' WHEN 2 THEN 'Ann Lee' WHEN 3 THEN 'Jean Luc Blanc' ELSE '' END AS author FROM customer""")
def default_author(t: Tables) -> DataFrame:
    """The author of a document that names none: its source's, unless that is a repository; then the first name in what stands around the link, turned round where the surname comes first."""
    row = t("customer", "c_custkey").selectExpr("c_custkey", "CASE c_custkey % 5 WHEN 0 THEN 'personal' ELSE 'repo' END AS kind", "CASE c_custkey % 5 WHEN 1 THEN 'Smith, John (2001)' WHEN 2 THEN 'Ann Lee and Bob Ray' WHEN 3 THEN 'Blanc, Jean Luc | A title' ELSE '' END AS c")
    parts = F.transform(F.split("c", r",|\||\(| and "), lambda x: F.trim(x))
    first, second = F.get(parts, 0), F.get(parts, 1)
    parsed = F.when(first.isNotNull() & (first != "") & ~F.contains(first, F.lit(" ")) & second.isNotNull(), F.concat_ws(" ", second, first)).otherwise(first)
    return row.select("c_custkey", F.when(F.col("kind") != "repo", "Default Author").otherwise(parsed).alias("author"))


@paired(f"""SELECT doc_id, CASE WHEN old OR NOT confirmed THEN 0 ELSE epoch_us({NOW}) END AS found, NOT old AND confirmed AND (paper < 60 OR topic < 60 OR conf < 60) AS hidden
FROM (SELECT doc_id, doc_id % 7 = 0 AS old, doc_id % 5 <> 0 AS confirmed, doc_id * 13 % 100 AS paper, doc_id * 29 % 100 AS topic, 50 + doc_id * 17 % 50 AS conf FROM documents)""")
def review_ladder(t: Tables) -> DataFrame:
    """Date and visibility of a new document: an old one, or one from a source that isn't confirmed, is no news (its date is 1970); another is hidden for review if one of its three scores is low. State and scores are made up from doc_id."""
    row = t("documents", "doc_id").selectExpr("doc_id", "doc_id % 7 = 0 AS old", "doc_id % 5 = 0 AS unconfirmed", "array(doc_id * 13 % 100, doc_id * 29 % 100, 50 + doc_id * 17 % 50) AS scores")
    ladder = F.when(F.col("old"), "old").when(F.col("unconfirmed"), "new source").when(F.exists("scores", lambda s: s < 60), "low").otherwise("fine")
    row = row.select("doc_id", ladder.alias("step"))
    return row.select("doc_id", F.when(F.col("step").isin("old", "new source"), 0).otherwise(F.expr(f"unix_micros({NOW})")).alias("found"), (F.col("step") == "low").alias("hidden"))


@paired("""SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'https://dl.dropboxusercontent.com/s/' || p_partkey || '/a.pdf' WHEN 1 THEN 'https://arxiv.org/pdf/' || p_partkey || '.pdf' WHEN 2 THEN 'https://philpapers.org/archive/ABC-' || p_partkey || '.pdf' WHEN 3 THEN 'https://x.org/' || p_partkey || '/1/document.pdf' WHEN 4 THEN 'https://x.org/bitstream/12/' || p_partkey || '/1/text.pdf' WHEN 5 THEN 'https://hal.science/hal-' || p_partkey || '/document' WHEN 6 THEN 'https://osf.io/ab12c/download' WHEN 7 THEN 'https://x.org/one.pdf' END AS target FROM part""")
def steppingstone(t: Tables) -> DataFrame:
    """The document that a page leads to: by the rules of repositories, else its only PDF link, unless it is an entry of an encyclopedia."""
    urls = ["https://www.dropbox.com/s/{k}/a.pdf?dl=0", "http://arxiv.org/abs/{k}", "https://philpapers.org/rec/ABC-{k}", "http://x.org/eprint/{k}/", "https://x.org/handle/12/{k}", "https://hal.science/hal-{k}", "https://osf.io/ab12c", "https://x.org/p", "https://x.org/p", "https://plato.example.org/entries/x/"]
    url = f"replace(get(array({', '.join(repr(u) for u in urls)}), p_size % 10), '{{k}}', CAST(p_partkey AS STRING))"
    html = "CASE p_size % 10 WHEN 7 THEN '<a href=\"one.pdf\">x</a> <a href=\"one.pdf\">y</a>' WHEN 8 THEN '<a href=\"one.pdf\">x</a> <a href=\"two.pdf\">y</a>' WHEN 9 THEN '<a href=\"one.pdf\">x</a>' ELSE '' END"
    row = t("part", "p_partkey", "p_size").selectExpr("p_partkey", f"{url} AS url", f"{html} AS html")
    rules = [F.when(F.col("url").rlike(p), F.regexp_replace("url", p, to)) for p, to in REPOSITORIES]
    pdfs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+[.]pdf)"'), F.lit(1)))
    only = F.when((F.size(pdfs) == 1) & ~F.col("url").rlike("//(plato|encyclopedia|iep)[.]"), F.concat(F.regexp_extract("url", "^(https?://[^/]+/)", 1), F.get(pdfs, 0)))
    return row.select("p_partkey", F.coalesce(*rules, only).alias("target"))


@paired("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'jsessionid,phpsessid,ref,sid,x' WHEN 1 THEN 'jsessionid,phpsessid,ref,sid,visit' ELSE 'jsessionid,phpsessid,sid' || CASE WHEN p_size % 5 = 2 THEN ',tab' ELSE '' END END AS vars FROM part""")
def page_session_vars(t: Tables) -> DataFrame:
    """The session variables of a page: some that are known everywhere, and the parameters that occur in more than two of its links."""
    links = "CASE p_size % 5 WHEN 0 THEN repeat('<a href=\"/a?ref=1&amp;x=2\">a</a>', 3) WHEN 1 THEN repeat('<a href=\"/b?visit=7;ref=1\">b</a>', 4) WHEN 2 THEN repeat('<a href=\"?tab=7\">b</a>', 3) WHEN 3 THEN repeat('<a href=\"/c?once=1\">c</a>', 2) ELSE '<p>no links</p>' END"
    seen = t("part", "p_partkey", "p_size").select("p_partkey", F.expr(f"regexp_extract_all({links}, '[?&;]([a-zA-Z_]+)=', 1)").alias("a"))
    often = F.filter(F.array_distinct("a"), lambda p: F.size(F.filter("a", lambda x: x == p)) > 2)
    return seen.select("p_partkey", F.array_join(F.array_sort(F.array_union(F.array(*map(F.lit, ("sid", "phpsessid", "jsessionid"))), often)), ",").alias("vars"))


@paired("""SELECT page_id, string_agg(DISTINCT l, ',' ORDER BY l) AS labels FROM (SELECT page_id, unnest(['page', split_part(url, '/', 4), CASE WHEN url LIKE 'https%' THEN 'secure' ELSE 'page' END, CASE WHEN url LIKE '%?%' THEN 'query' END]) AS l FROM pages) WHERE l IS NOT NULL GROUP BY page_id""")
def label_union(t: Tables) -> DataFrame:
    """The labels of several lists, each once."""
    lists = F.array(F.array(F.lit("page"), F.get(F.split("url", "/"), 3)), F.array(F.when(F.col("url").startswith("https"), "secure").otherwise("page")), F.array(F.when(F.contains("url", F.lit("?")), "query")))
    return t("pages", "page_id", "url").select("page_id", F.array_join(F.array_sort(F.array_compact(F.array_distinct(F.flatten(lists)))), ",").alias("labels"))


@paired("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE greatest(p_size / 50e0, 0.3e0, CASE WHEN p_type = 'SMALL' THEN 1e0 ELSE 0e0 END) END AS any_, CASE WHEN p_size % 4 = 0 THEN NULL ELSE least(p_size / 50e0, 0.3e0, CASE WHEN p_type = 'SMALL' THEN 1e0 ELSE 0e0 END) END AS all_ FROM part""")
def fuzzy_any_all(t: Tables) -> DataFrame:
    """Fuzzy OR and AND of three truths, null where one of them is."""
    from lectio.functions.rulepack import f_and, f_or

    truths = ["CASE WHEN p_size % 4 <> 0 THEN p_size / 50e0 END", "0.3e0", "CASE WHEN p_type = 'SMALL' THEN 1e0 ELSE 0e0 END"]
    return t("part", "p_partkey", "p_size", "p_type").selectExpr("p_partkey", f"{f_or(*truths)} AS any_", f"{f_and(*truths)} AS all_")


@paired(r"""SELECT doc_id, count(*) AS words, sum(CASE WHEN k.w IS NULL THEN 0 ELSE 1 END) AS known FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL) d
LEFT JOIN (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '')) AS w FROM benchmark WHERE text IS NOT NULL) k ON k.w = d.w GROUP BY doc_id""")
def dictionary_words(t: Tables) -> DataFrame:
    """Words of a document, and how many of them are in a list, here the words of the known texts: counted by word first, so that a word that a third of all texts have is one row for each."""
    words = lambda name, *more: t(name, *more, "text").where("text IS NOT NULL").select(*more, F.explode(F.expr("filter(split(lower(text), '[^\\\\p{L}]+', -1), x -> x <> '')")).alias("w"))
    listed = words("benchmark").distinct().withColumn("hit", F.lit(1))
    counted = words("documents", "doc_id").groupBy("doc_id", "w").count()
    return counted.join(listed, "w", "left").groupBy("doc_id").agg(F.sum("count").alias("words"), F.sum(F.when(F.col("hit") == 1, F.col("count")).otherwise(0)).alias("known"))


@paired("""SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey WHERE levenshtein(a.p_name, b.p_name) < 3""")
def near_titles(t: Tables) -> DataFrame:
    """Pairs of titles within a group that fewer than three edits part: the distinct titles are compared, and then taken apart into their rows."""
    rows = t("part", "p_partkey", "p_name", "p_size", "p_type").where("p_name IS NOT NULL")
    blocks = pairs.classes(rows, "p_partkey", "p_size", "p_type", "p_name")
    return pairs.expand(pairs.alike(blocks, ["p_size", "p_type"], "p_name", "levenshtein(a.p_name, b.p_name, 2) >= 0"))


@paired("""SELECT p_partkey, p_size % 3 <> 2 AS found FROM part""")
def approximate_substring(t: Tables) -> DataFrame:
    """Whether a name is in a text with up to a fifth of its letters edited, at any place: the least edit distance to any window of about its length."""
    text = "concat('some words before ', CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(substr(p_name, 1, 2), 'x', substr(p_name, 4)) ELSE reverse(upper(p_name)) END, ' and some after')"
    row = t("part", "p_partkey", "p_name", "p_size").selectExpr("p_partkey", "p_name", f"{text} AS text", "length(p_name) AS n")
    near = "exists(sequence(1, length(text)), i -> exists(sequence(n - most, n + most), m -> levenshtein(substr(text, i, m), p_name, most) >= 0))"
    return row.withColumn("most", F.ceil(F.col("n") * 0.2).cast("int")).select("p_partkey", F.expr(near).alias("found"))


def _context() -> list[str]:
    """What leads to a document: its address, the text of its link, and what stands around that; made up from doc_id so that every branch occurs, with the confidence of its parse."""
    pick = lambda *v: f"get(array({', '.join(repr(x) for x in v)}), CAST(doc_id % {len(v)} AS INT))"
    return [
        f"{pick('http://x.org/papers/a.pdf', 'http://x.org/courses/b.pdf', 'http://x.org/c.pdf', 'http://x.org/talks/d.pdf', 'http://x.org/e.pdf')} AS url",
        f"{pick('Download', 'Slides', 'pdf', 'Home page', 'A title', 'site map', 'Handout 3')} AS anchor",
        f"{pick('', 'Penultimate draft', 'in Mind 2004', 'Forthcoming in Noûs', 'a chapter in a volume', 'my thesis', 'review of a book')} AS context",
        "CAST(40 + doc_id * 13 % 60 AS DOUBLE) AS confidence",
    ]


_DUCK_CONTEXT = """SELECT doc_id, doc_id % 5 IN (1, 3) AS bad_url, doc_id % 7 IN (1, 3, 5, 6) AS bad_anchor, doc_id % 7 IN (1, 3) AS good_context, doc_id % 7 = 0 AS no_context, doc_id % 7 = 4 AS chapter, doc_id % 7 = 5 AS thesis, doc_id % 7 = 6 AS review, 40 + doc_id * 13 % 60 AS confidence, len(list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL"""


def _nb(k: str, n: int, p: float) -> str:
    """The probability of k failures before the n-th success, by factorials, for DuckDB."""
    return f"greatest(exp(lgamma({k} + {n}) - lgamma({n}) - lgamma({k} + 1) + {n} * ln({p}) + {k} * ln({1 - p})), 1e-10)"


def _smooth(k: str, yes: tuple[int, float], no: tuple[int, float]) -> str:
    a, b = _nb(k, *yes), _nb(k, *no)
    return f"ln(greatest({a}, ({a} + {b}) / 2)) - ln(greatest({b}, ({a} + {b}) / 2))"


@paired(f"""SELECT doc_id, round(1 / (1 + exp(-(ln(0.6 / 0.4) + CASE WHEN bad_url THEN ln(0.05 / 0.2) ELSE ln(0.95 / 0.8) END + CASE WHEN bad_anchor THEN ln(0.005 / 0.3) ELSE ln(0.995 / 0.7) END
+ CASE WHEN good_context THEN ln(0.2 / 0.05) ELSE ln(0.8 / 0.95) END + {_smooth('confidence', (6, 0.1), (3, 0.1))}))), 6) AS p FROM ({_DUCK_CONTEXT})""")
def score_link(t: Tables) -> DataFrame:
    """How much the way to a document tells that it is a paper: its address, the link's text, what stands around it, and the confidence of the parse."""
    from lectio.functions.score import binary, count_ratio, posterior

    hit = lambda c, p: f"({c} RLIKE r'(?i){p}')"
    ratios = [binary(hit("url", r"\bcours|\blecture|\btalk|handout|teaching"), 0.05, 0.2), binary(hit("anchor", r"^site\s*map$|^home|page\b|\bslides\b|handout"), 0.005, 0.3), binary(hit("context", "penultimate|draft|forthcoming"), 0.2, 0.05), count_ratio("confidence", (6, 0.1), (3, 0.1), True)]
    return t("documents", "doc_id", "text").where("text IS NOT NULL").selectExpr("doc_id", *_context()).selectExpr("doc_id", f"round({posterior(0.6, ratios)}, 6) AS p")


@paired(f"""WITH w AS (SELECT doc_id, no_context, chapter, thesis, review, CAST(words AS DOUBLE) AS k FROM ({_DUCK_CONTEXT})), s AS (SELECT doc_id, 1 / (1 + exp(-(ln(0.25) + {_smooth('k', (2, 0.0002), (3, 0.0002))} + CASE WHEN no_context THEN 0 WHEN chapter THEN ln(0.7 / 0.05) ELSE ln(0.3 / 0.95) END))) AS chapter,
1 / (1 + exp(-(ln(0.25) + ln({_nb('k', 7, 0.0001)}) - ln({_nb('k', 1, 0.0001)}) + CASE WHEN no_context THEN 0 WHEN thesis THEN ln(0.7 / 0.05) ELSE ln(0.3 / 0.95) END))) AS thesis,
1 / (1 + exp(-(ln(0.15 / 0.85) + {_smooth('k', (2, 0.0003), (3, 0.0002))} + CASE WHEN no_context THEN 0 WHEN review THEN ln(0.8 / 0.03) ELSE ln(0.2 / 0.97) END))) AS review FROM w)
SELECT doc_id, round(chapter, 6) AS chapter, round(thesis, 6) AS thesis, round(review, 6) AS review, CASE WHEN greatest(chapter, thesis, review) <= 0.5 THEN 'article' WHEN chapter = greatest(chapter, thesis, review) THEN 'chapter' WHEN thesis = greatest(chapter, thesis, review) THEN 'thesis' ELSE 'review' END AS doctype FROM s""")
def doctype_by_context(t: Tables) -> DataFrame:
    """Chapter, thesis or review by length and by what stands around the link, which is passed over where there is nothing; the likeliest over one half, else an article."""
    from lectio.functions.score import binary, count_ratio, posterior

    seen = lambda p, y, n: binary(f"contains(lower(context), '{p}')", y, n, "context <> ''")
    c = lambda y, n, s: count_ratio("words", y, n, s)
    kinds = {"chapter": posterior(0.2, [c((2, 0.0002), (3, 0.0002), True), seen("chapter", 0.7, 0.05)]), "thesis": posterior(0.2, [c((7, 0.0001), (1, 0.0001), False), seen("thesis", 0.7, 0.05)]), "review": posterior(0.15, [c((2, 0.0003), (3, 0.0002), True), seen("review of", 0.8, 0.03)])}
    row = t("documents", "doc_id", "text").where("text IS NOT NULL").selectExpr("doc_id", "CAST(regexp_count(text, '[^ \t\r\n]+') AS DOUBLE) AS words", *_context()).selectExpr("doc_id", *(f"{v} AS {k}" for k, v in kinds.items()))
    high = "greatest(chapter, thesis, review)"
    return row.selectExpr("doc_id", *(f"round({k}, 6) AS {k}" for k in kinds), f"CASE WHEN {high} <= 0.5 THEN 'article' {' '.join(f'WHEN {k} = {high} THEN {chr(39)}{k}{chr(39)}' for k in kinds)} END AS doctype")


@paired("""SELECT doc_id, turn_labels, CASE WHEN n > 8 THEN list_sum(list_transform(p, lambda x: CASE WHEN x > 0.6 THEN 1 ELSE 0 END)) ELSE n END AS kept FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: least(1.0, length(x) % 100 / 100.0)) AS p, len(string_split(text, chr(10))) AS n, 'AUTHOR' AS turn_labels FROM documents WHERE text IS NOT NULL)""")
def candidate_pruning(t: Tables) -> DataFrame:
    """Candidates of a label: where a document has more than eight, only those over 0.6 stay. A line's score is made up from its length."""
    scores = F.transform(F.split("text", "\n", -1), lambda x: F.length(x) % 100 / 100)
    kept = F.when(F.size("p") > 8, F.size(F.filter("p", lambda x: x > 0.6))).otherwise(F.size("p"))
    return t("documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", scores.alias("p")).select("doc_id", F.lit("AUTHOR").alias("turn_labels"), kept.alias("kept"))


@paired("""WITH a AS (SELECT p_partkey, p_size % 3 + 1 AS n, (p_size % 3 + 1) * (p_size % 2 + 1) AS n2 FROM part) SELECT p_partkey, i, i % n AS first, i // n AS second FROM a, range(0, 6) r(i) WHERE i < n2""")
def parsing_generator(t: Tables) -> DataFrame:
    """All readings of the atoms of a text, one row each: which label of the first and of the second atom, by counting in mixed radix; nothing is left out."""
    row = t("part", "p_partkey", "p_size").selectExpr("p_partkey", "array(CAST(p_size % 3 + 1 AS BIGINT), CAST(p_size % 2 + 1 AS BIGINT)) AS radix")
    return row.selectExpr("p_partkey", "radix", "explode(sequence(0L, aggregate(radix, 1L, (a, r) -> a * r) - 1)) AS i").selectExpr("p_partkey", "i", "i % radix[0] AS first", "i DIV radix[0] AS second")


@paired("""SELECT doc_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY v, i) AS order_ FROM (SELECT doc_id, i, round(abs(p - q) / sqrt(2), 9) AS v FROM (SELECT doc_id, i, (doc_id * 7 + i * 3) % 10 / 10e0 AS p, (doc_id + i) % 10 / 10e0 AS q FROM documents, range(0, 5) r(i))) GROUP BY doc_id""")
def atoms_by_variance(t: Tables) -> DataFrame:
    """Atoms in the order in which they are tried: by the spread of their labels' scores, the least first."""
    atoms = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(F.round(F.abs((F.col("doc_id") * 7 + i * 3) % 10 / 10 - (F.col("doc_id") + i) % 10 / 10) / F.sqrt(F.lit(2.0)), 9).alias("v"), i.alias("i")))
    return t("documents", "doc_id").select("doc_id", F.array_join(F.transform(F.array_sort(atoms), lambda x: x["i"].cast("string")), ",").alias("order_"))


_SPAM = [("filetype", 1, 0), ("bad_anchor", 0.3, -0.1), ("bad_path", 0.3, -0.1), ("index_file", 0.4, -0.1), ("course", 0.3, -0.1), ("paper", -0.4, 0.1), ("interview", 0.2, 0), ("few_verbs", 0.5, -0.1), ("short", 0.4, -0.1), ("long", -0.2, 0.2), ("short_lines", 0.4, 0), ("low_confidence", 0.3, -0.1)]
_COUNTS = {"course": ("course|homework|lecture|seminar", 1000), "paper": ("in section|finally,", 4000), "interview": ("interview|do you", 2000)}


def _duck_estimate(rules: list[tuple[str, float, float]]) -> str:
    """The score estimator for DuckDB as it is defined, over a list of scores: each side by its product, weighed by its exponentials."""
    scores = "[" + ", ".join(f"({f}) * {a} + (1 - ({f})) * {b}" for f, a, b in rules) + "]"
    side = lambda c: f"list_filter(s, lambda x: x {c})"
    product = lambda c: f"coalesce(list_product(list_transform({side(c)}, lambda x: 1 - abs(x))), 1)"
    weight = lambda c: f"0.01 + coalesce(list_sum(list_transform({side(c)}, lambda x: exp(5 * (0.5 + abs(x))))), 0)"
    return f"list_transform([{scores}], lambda s: ((1 - {product('>= 0')} / 2) * ({weight('>= 0')}) + {product('< 0')} / 2 * ({weight('< 0')})) / ({weight('>= 0')} + {weight('< 0')}))[1]"


_DUCK_SPAM = {
    "filetype": "0e0", "bad_anchor": "CAST(doc_id % 7 IN (1, 3, 5, 6) AS INT)", "bad_path": "CAST(doc_id % 5 IN (1, 3) AS INT)", "index_file": "0e0",
    **{k: f"least(1e0, {w}e0 * len(regexp_extract_all(lower(text), '{p}')) / greatest(1, length(text)))" for k, (p, w) in _COUNTS.items()},
    "few_verbs": "greatest(0e0, 1 - 1000e0 * len(list_filter(string_split_regex(text, '[^a-zA-Z]+'), lambda x: x = 'is')) / greatest(1, length(text)))", "short": "greatest(0e0, least(1e0, 1.5e0 - length(text) / 5000e0))", "long": "least(1e0, length(text) / 70000e0)",
    "short_lines": "greatest(0e0, least(1e0, 1.3e0 - list_median(list_transform(string_split(text, chr(10)), lambda x: length(x))) / 70e0))", "low_confidence": "1 - (40 + doc_id * 13 % 60) / 100e0",
}


@paired(f"""SELECT doc_id, round({_duck_estimate([(_DUCK_SPAM[n], a, b) for n, a, b in _SPAM])}, 6) AS spam FROM documents WHERE text IS NOT NULL""".replace("list_product(", "list_aggregate(").replace("1 - abs(x))), 1)", "1 - abs(x)), 'product'), 1)"))
def score_spam(t: Tables) -> DataFrame:
    """How likely a document is nothing that is looked for, by a pack of rules."""
    from lectio.functions.rulepack import Registry, Rule, label

    yes = lambda c: f"CASE WHEN {c} THEN 1e0 ELSE 0e0 END"
    names = Registry().add(
        filetype=yes("lower(url) RLIKE '[.](ppt|php|asp|jpg|png|ttf)$'"), bad_anchor=yes(r"anchor RLIKE r'(?i)^site\s*map$|^home|page\b|\bslides\b|handout'"), bad_path=yes("url RLIKE 'cours|lectur|talk|handout|teaching'"), index_file=yes("url RLIKE '^https?://[^/]+/?(index[.][a-z]+)?$'"),
        **{k: f"least(1e0, {w}e0 * regexp_count(low, '{p}') / greatest(1, n))" for k, (p, w) in _COUNTS.items()},
        few_verbs="greatest(0e0, 1 - 1000e0 * size(filter(split(text, '[^a-zA-Z]+', -1), x -> x = 'is')) / greatest(1, n))", short="greatest(0e0, least(1e0, 1.5e0 - n / 5000e0))", long="least(1e0, n / 70000e0)",
        short_lines="greatest(0e0, least(1e0, 1.3e0 - (sizes[(size(sizes) - 1) DIV 2] + sizes[size(sizes) DIV 2]) / 2e0 / 70e0))", low_confidence="1 - confidence / 100e0",
    )
    row = t("documents", "doc_id", "text").where("text IS NOT NULL").selectExpr("doc_id", "text", "lower(text) AS low", "length(text) AS n", "array_sort(transform(split(text, '\n', -1), x -> length(x))) AS sizes", *_context())
    return label(row, names, {"SPAM": [Rule(n, a, b) for n, a, b in _SPAM]}).select("doc_id", F.round("p_SPAM", 6).alias("spam"))
