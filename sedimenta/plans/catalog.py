"""Named queries over the driver tables, and the same in DuckDB SQL.

``pages`` stands in for captures with payload, ``documents`` and ``events`` for records with metadata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.archive import Archive, Config, Field, load_json, save_rows, save_text
from sedimenta.functions import entities, http, urls
from sedimenta.operators import graph, revisits
from sedimenta.operators.functions import AbsoluteUrl, Data, Entities, Html, HtmlAttribute, HtmlText, HttpPayload, LowerCase, SURT, StringContent, Values
from sedimenta.operators.paths import Pointer, parse
from sedimenta.plans import scratch
from sedimenta.sources import cdx, files, warc

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__.lstrip("_")] = f
        if sql is not None:
            ORACLES[f.__name__.lstrip("_")] = _MACROS(sql)
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> Archive:
    return Archive.of_pages(_table(spark, sf_dir, "pages"))


def _documents(spark: SparkSession, sf_dir: str) -> Archive:
    df = _table(spark, sf_dir, "documents")
    return Archive(df, ["doc_id", "lang", "source", "n_chars"], {parse("payload.string"): Field("text", "string", hidden=True)})


# --- SQL building blocks ------------------------------------------------------------------------------------------------

_BREAKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"


def _dec(x: str) -> str:
    for name, c in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{c}', 'g')"
    return x


def _txt(x: str) -> str:
    for pattern, to in (("(?s)<!--.*?-->", ""), (r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", ""), (f"(?i)</?(?:{_BREAKS})(?:[ /][^>]*)?>", " "), ("(?s)<[^>]*>", "")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return rf"trim(regexp_replace({_dec(x)}, '\s+', ' ', 'g'))"


def _surt(u: str) -> str:
    host = f"lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#:]*)', 1))"
    rest = f"regexp_extract(regexp_replace({u}, '#.*$', ''), '^[a-zA-Z]+://[^/?]*(.*)$', 1)"
    return rf"array_to_string(list_reverse(string_split(regexp_replace({host}, '^www[0-9]*\.', ''), '.')), ',') || ')' || CASE WHEN {rest} = '' THEN '/' WHEN {rest} LIKE '?%' THEN '/' || {rest} ELSE {rest} END"


_TITLE = "regexp_extract(html, '(?s)<title>.*?</title>')"
_ORIGIN = "regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)"
_HREF = _dec("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")
_LINKS = "(SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<a [^>]*>.*?</a>')) AS a FROM pages)"
_TERMS = r"(SELECT page_id, unnest(list_filter(string_split_regex(lower(%s), '[^A-Za-z0-9_]+'), lambda x: x <> '')) AS term FROM pages)"


def _MACROS(sql: str) -> str:
    for k, v in {"$TITLE_TEXT": _txt(_TITLE), "$TITLE": _TITLE, "$HREF": _HREF, "$A_TEXT": _txt("a"), "$LINKS": _LINKS, "$ORIGIN": _ORIGIN, "$SURT_LINK": _surt(f"({_ORIGIN} || {_HREF})"), "$SURT": _surt("url"), "$BODY": _txt("regexp_extract(html, '(?s)<body>.*')")}.items():
        sql = sql.replace(k, v)
    return sql


TITLE = HtmlText().of(Html.first("title"))
LINKS = Html.all("a")
HREF = HtmlAttribute("href").of_each(LINKS)
ANCHOR = HtmlText().of_each(LINKS)
LINK_SURT = SURT().of(HREF)
EDGE = Values(Pointer("page_id"), LINK_SURT, ANCHOR, field="edge").of_each(LINKS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and number of links of the English pages: metadata filter first, payload after."""
    a = _pages(spark, sf_dir).filter(F.col("originalUrl").contains("/en/")).enrich(TITLE).enrich(HREF)
    return a.select("page_id", "originalUrl", title=TITLE, links=HREF).withColumn("links", F.coalesce(F.size("links"), F.lit(0)))


# --- metadata -----------------------------------------------------------------------------------------------------------


@_query("SELECT page_id, url, $SURT AS surt, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages")
def load_meta(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", "url", urls.surt(F.col("url")).alias("surt"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"))


@_query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500")
def filter_meta(spark, sf_dir):
    return _documents(spark, sf_dir).filter("lang = 'en' and n_chars > 500").df.select("doc_id", "source", "n_chars")


@_query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def filter_time_range(spark, sf_dir):
    return _table(spark, sf_dir, "events").filter("ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'").select("event_id", "user_id", "event_type")


# --- HTML ---------------------------------------------------------------------------------------------------------------


@_query("SELECT page_id, $TITLE AS title FROM pages")
def html_first_title(spark, sf_dir):
    return _pages(spark, sf_dir).enrich(Html.first("title")).select("page_id", title=Html.first("title"))


@_query("SELECT page_id, $TITLE_TEXT AS title FROM pages")
def html_text_title(spark, sf_dir):
    return _pages(spark, sf_dir).enrich(TITLE).select("page_id", title=TITLE)


@_query("SELECT page_id, lower($TITLE_TEXT) AS title FROM pages")
def lowercase_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", title=LowerCase().of(TITLE))


@_query("SELECT a AS value FROM $LINKS")
def html_all_links(spark, sf_dir):
    return _pages(spark, sf_dir).flat_map_values(LINKS)


@_query("SELECT $HREF AS value FROM $LINKS")
def link_hrefs(spark, sf_dir):
    return _pages(spark, sf_dir).flat_map_values(HREF)


@_query("SELECT $A_TEXT AS value FROM $LINKS")
def link_texts(spark, sf_dir):
    return _pages(spark, sf_dir).flat_map_values(ANCHOR)


@_query("SELECT page_id, (regexp_extract_all(html, '(?s)<a [^>]*>.*?</a>'))[3] AS third FROM pages")
def html_nth_tag(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", third=Html("a", 2))


@_query("SELECT page_id, $BODY AS body FROM pages")
def body_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", body=HtmlText())


@_query("SELECT page_id, $ORIGIN || $HREF AS link FROM $LINKS")
def absolute_links(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", link=AbsoluteUrl().of(HREF)).select("page_id", F.explode("link").alias("link"))


@_query("SELECT page_id, $SURT AS surt FROM pages")
def surt_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", surt=SURT().of(Pointer("originalUrl")))


@_query("SELECT page_id, $SURT_LINK AS surt FROM $LINKS")
def surt_links(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", surt=LINK_SURT).select("page_id", F.explode("surt").alias("surt"))


# --- pointers -----------------------------------------------------------------------------------------------------------


@_query("SELECT page_id, length($TITLE_TEXT) AS n FROM pages")
def map_value(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", n=TITLE.map("length", lambda c: F.length(c).cast("long"), "bigint"))


@_query("SELECT page_id, term FROM " + _TERMS % "$TITLE_TEXT")
def map_multi_terms(spark, sf_dir):
    terms = TITLE.map_multi("terms", lambda c: F.filter(F.split(F.lower(c), "[^A-Za-z0-9_]+"), lambda x: x != ""))
    return _pages(spark, sf_dir).select("page_id", term=terms).select("page_id", F.explode("term").alias("term"))


@_query("SELECT page_id, length($TITLE_TEXT) + 1 AS longer FROM pages")
def map_identity(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", longer=TITLE.map_identity("same").map("longer", lambda c: (F.length(c) + 1).cast("long"), "bigint"))


@_query("SELECT page_id, $TITLE AS parent, regexp_extract(html, '(?s)<h1>.*?</h1>') AS sibling FROM pages")
def pointer_child_sibling_parent(spark, sf_dir):
    a = _pages(spark, sf_dir).enrich(TITLE).enrich(Html.first("h1"))
    return a.select("page_id", parent=TITLE.parent, sibling=TITLE.parent.sibling("h1"))


@_query("SELECT page_id, (regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))[1] AS first, len(regexp_extract_all(html, '<a '))::BIGINT AS n FROM pages")
def pointer_index_each(spark, sf_dir):
    a = _pages(spark, sf_dir).enrich(HREF)
    return a.select("page_id", first=Pointer("payload.string.html.a[0].attributes.href"), n=Pointer("payload.string.html.a*.attributes.href")).withColumn("n", F.coalesce(F.size("n"), F.lit(0)).cast("long"))


@_query("SELECT page_id, $TITLE AS title FROM pages")
def pointer_deep_search(spark, sf_dir):
    a = _pages(spark, sf_dir).enrich(Html.first("title"))
    return a.select("page_id", title=Pointer(["", "title"]))


# --- filters and getters ------------------------------------------------------------------------------------------------


@_query("SELECT page_id FROM pages WHERE regexp_matches(html, '<b>')")
def filter_exists(spark, sf_dir):
    return _pages(spark, sf_dir).enrich(Html.first("b")).filter_exists(Html.first("b")).df.select("page_id")


@_query("SELECT page_id FROM pages WHERE false")
def filter_exists_unenriched(spark, sf_dir):
    return _pages(spark, sf_dir).filter_exists(Html.first("b")).df.select("page_id")


@_query("SELECT page_id, $TITLE_TEXT AS title FROM pages WHERE length($TITLE_TEXT) > 40")
def filter_value(spark, sf_dir):
    return _pages(spark, sf_dir).filter_value(TITLE, lambda c: F.length(c) > 40).select("page_id", title=TITLE)


@_query("SELECT page_id FROM pages WHERE len(regexp_extract_all(html, '<a ')) > 0")
def filter_nonempty(spark, sf_dir):
    return _pages(spark, sf_dir).filter_non_empty(LINKS).df.select("page_id")


@_query("SELECT page_id FROM pages WHERE page_id % 7 <> 0")
def filter_no_exception(spark, sf_dir):
    fails = Pointer("page_id").map_python("checked", lambda v: 1 // (v % 7) * 0, "int")
    return _pages(spark, sf_dir).enrich(fails).filter_no_exception().df.select("page_id")


@_query("SELECT $TITLE_TEXT AS value FROM pages")
def map_values(spark, sf_dir):
    return _pages(spark, sf_dir).map_values(TITLE)


@_query("SELECT $HREF AS value FROM $LINKS")
def flat_map_values(spark, sf_dir):
    return _pages(spark, sf_dir).flat_map_values(HREF)


@_query("SELECT page_id, coalesce(nullif(regexp_extract(html, '(?s)<h2>.*?</h2>'), ''), 'none') AS h2 FROM pages")
def value_or_else(spark, sf_dir):
    a = _pages(spark, sf_dir).enrich(Html.first("h2"))
    return a.df.select("page_id", a.value_or_else(Html.first("h2"), "none").alias("h2"))


@_query("SELECT page_id, 'crawl-1' AS label FROM pages")
def enrich_value(spark, sf_dir):
    return _pages(spark, sf_dir).enrich_value("label", "crawl-1").select("page_id", label=Pointer("label"))


# --- distinct values and counts -----------------------------------------------------------------------------------------


@_query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def distinct_value_earliest(spark, sf_dir):
    df = _table(spark, sf_dir, "events")
    return Archive(df, df.columns).distinct_value("user_id", ["ts", "event_id"]).df.select("user_id", "event_id", "event_type")


@_query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def distinct_value_digest(spark, sf_dir):
    a = _documents(spark, sf_dir)
    digest = Pointer("payload.string").map("digest", lambda c: F.md5(c.cast("binary")))
    return a.distinct_value(digest, ["doc_id"]).select("doc_id", digest=digest)


@_query("SELECT toxic, doc_id FROM (SELECT l.toxic, d.doc_id, row_number() OVER (PARTITION BY l.toxic ORDER BY d.doc_id) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE n = 1")
def distinct_value_nullkey(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").select("doc_id").join(_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return Archive(df, df.columns).distinct_value("toxic", ["doc_id"]).df.select("toxic", "doc_id")


@_query("SELECT term AS value, count(*) AS \"count\" FROM " + _TERMS % "$TITLE_TEXT" + " GROUP BY term")
def count_by_value_terms(spark, sf_dir):
    terms = TITLE.map_multi("terms", lambda c: F.filter(F.split(F.lower(c), "[^A-Za-z0-9_]+"), lambda x: x != ""))
    return _pages(spark, sf_dir).flat_map_values(terms).groupBy("value").count()


@_query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(list_distinct(string_split_regex(text, '[^A-Za-z0-9_]+'))) AS w FROM documents WHERE lang = 'en') WHERE length(w) > 3 GROUP BY w HAVING count(*) > 2")
def reduce_by_key_threshold(spark, sf_dir):
    docs = _documents(spark, sf_dir).filter("lang = 'en'")
    words = docs.df.select(F.explode(F.array_distinct(F.split("text", "[^A-Za-z0-9_]+"))).alias("word")).filter(F.length("word") > 3)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 2")


@_query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) WHERE length(w) > 2 GROUP BY w ORDER BY n DESC, w LIMIT 20")
def top_terms(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter(F.length("word") > 2)
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)


# --- values, joins, graphs ----------------------------------------------------------------------------------------------


@_query("SELECT page_id::VARCHAR AS src, $SURT_LINK AS dst, $A_TEXT AS anchor FROM $LINKS")
def values_edge_list(spark, sf_dir):
    e = _pages(spark, sf_dir).flat_map_values(EDGE)
    return e.select(F.col("value")[0].alias("src"), F.col("value")[1].alias("dst"), F.col("value")[2].alias("anchor"))


@_query("SELECT page_id, page_id::VARCHAR || '|' || coalesce(nullif(regexp_extract(html, '(?s)<h2>.*?</h2>'), ''), '-') AS pair FROM pages")
def values_defaults(spark, sf_dir):
    both = Values(Pointer("page_id"), Html.first("h2"), field="both").with_defaults(None, "-")
    return _pages(spark, sf_dir).select("page_id", pair=both).withColumn("pair", F.array_join("pair", "|"))


@_query("SELECT page_id, url FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) IN (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) FROM pages WHERE url LIKE '%/de/%')")
def semi_join_selected(spark, sf_dir):
    host = F.regexp_extract("originalUrl", "^[a-z]+://([^/?#]*)", 1)
    a = _pages(spark, sf_dir)
    a = Archive(a.df.withColumn("host", host), [*a.record, "host"], a.tree)
    chosen = a.df.filter(F.col("originalUrl").contains("/de/")).select("host")
    return a.filter_in("host", chosen, "host").df.select("page_id", F.col("originalUrl").alias("url"))


@_query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def broadcast_set_filter(spark, sf_dir):
    return _documents(spark, sf_dir).filter(F.col("source").isin("src1", "src2", "src3")).df.select("doc_id", "source")


def _edges(spark, sf_dir):
    return _pages(spark, sf_dir).enrich(EDGE).select(src=SURT().of(Pointer("originalUrl")), dst=LINK_SURT).select("src", F.explode("dst").alias("dst"))


_EDGES = "(SELECT $SURT AS src, $SURT_LINK AS dst FROM $LINKS)"


@_query(f"SELECT url, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS url, 0 AS i, 1 AS o FROM {_EDGES} UNION ALL SELECT dst, 1, 0 FROM {_EDGES}) GROUP BY url")
def graph_degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@_query(f"SELECT count(*) AS n FROM (SELECT src FROM {_EDGES} UNION SELECT dst FROM {_EDGES})")
def graph_num_vertices(spark, sf_dir):
    return graph.n_vertices(_edges(spark, sf_dir))


@_query(f"SELECT md5(src) AS src_id, md5(dst) AS dst_id FROM {_EDGES} WHERE src IS NOT NULL AND dst IS NOT NULL")
def graph_ids(spark, sf_dir):
    return graph.with_ids(_edges(spark, sf_dir))


@_query("SELECT doc_id, list_contains(w, 'the') AS has_the, list_contains(w, 'der') AS has_der FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents)")
def keyword_flags(spark, sf_dir):
    w = F.split(F.lower("text"), " ")
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_contains(w, "the").alias("has_the"), F.array_contains(w, "der").alias("has_der"))


@_query("SELECT page_id, $HREF AS href FROM $LINKS WHERE $HREF LIKE '/t%'")
def stylesheet_pattern(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", href=HREF)
    return rows.select("page_id", F.explode(F.filter("href", lambda x: x.startswith("/t"))).alias("href"))


# --- output and round trips ---------------------------------------------------------------------------------------------


@_query("SELECT to_json({'record': {'page_id': page_id, 'originalUrl': url}, 'payload': {'string': {'html': {'title': {'text': $TITLE_TEXT}}}}})::VARCHAR AS value FROM pages")
def to_json_lines(spark, sf_dir):
    return _pages(spark, sf_dir).enrich(TITLE).to_json()


@_query("SELECT page_id, $TITLE_TEXT AS title FROM pages")
def json_reload(spark, sf_dir):
    a = _pages(spark, sf_dir).enrich(TITLE)
    path = scratch.path(spark, "json")
    a.save_json(path)
    return load_json(spark, path, a.schema()).select("record.page_id", F.col("payload.string.html.title.text").alias("title"))


def _captures(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.select(
        urls.surt(F.col("url")).alias("surtUrl"), F.lit("20240101000000").alias("timestamp"), F.col("url").alias("originalUrl"), F.lit("text/html").alias("mime"), F.lit(200).alias("status"), F.md5(F.col("html").cast("binary")).alias("digest"),
        F.lit(None).cast("string").alias("redirectUrl"), F.lit(None).cast("string").alias("meta"), F.length("html").cast("long").alias("compressedSize"), F.col("page_id").alias("offset"), F.lit("pages.warc.gz").alias("filename"),
    )


@_query("SELECT concat_ws(' ', $SURT, '20240101000000', url, 'text/html', '200', md5(html), '-', '-', length(html), page_id, 'pages.warc.gz') AS value FROM pages")
def to_cdx_lines(spark, sf_dir):
    return cdx.lines(_captures(spark, sf_dir))


@_query("SELECT $SURT AS surtUrl, url AS originalUrl, md5(html) AS digest, 200 AS status, page_id AS \"offset\" FROM pages")
def cdx_roundtrip(spark, sf_dir):
    path = scratch.path(spark, "cdx")
    cdx.save(_captures(spark, sf_dir), path)
    return cdx.read(spark, path).select("surtUrl", "originalUrl", "digest", "status", "offset")


_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nServer: one\r\nServer: two\r\n\r\n"


def _responses(spark, sf_dir) -> DataFrame:
    head = F.lit(_HEAD)
    return _table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("originalUrl"), F.concat(head, F.col("html")).cast("binary").alias("content"))


@_query("SELECT page_id, 'HTTP/1.1 200 OK' AS status, 'text/html' AS mime, 'utf-8' AS charset, 'two' AS server FROM pages")
def http_header_mime_charset(spark, sf_dir):
    a = Archive(_responses(spark, sf_dir), ["page_id", "originalUrl"], root_func=HttpPayload()).enrich(HttpPayload())
    rows = a.select("page_id", status=Pointer("httpStatusLine"), h=Pointer("httpHeader"))
    return rows.select("page_id", "status", http.mime_col(F.col("h")).alias("mime"), http.charset_col(F.col("h")).alias("charset"), http.header_col(F.col("h"), "Server").alias("server"))


@_query("SELECT page_id, trim(html) AS string FROM pages")
def string_content_decode(spark, sf_dir):
    a = Archive(_responses(spark, sf_dir), ["page_id", "originalUrl"], root_func=HttpPayload())
    return a.enrich(StringContent(limit=0)).select("page_id", string=StringContent(limit=0))


@_query(f"SELECT page_id, octet_length(encode(html))::BIGINT + {len(_HEAD)} AS n FROM pages")
def data_bytes(spark, sf_dir):
    a = Archive(_responses(spark, sf_dir), ["page_id", "originalUrl"], root_func=HttpPayload())
    return a.select("page_id", data=Data()).select("page_id", F.octet_length("data").cast("long").alias("n"))


def _written_warc(spark, sf_dir) -> str:
    a = Archive(_responses(spark, sf_dir).withColumn("timestamp", F.lit("20240101000000")), ["page_id", "originalUrl", "timestamp"], root_func=HttpPayload())
    path = scratch.path(spark, "warc")
    warc.save(a, path, created="2024-01-01T00:00:00Z")
    return path


@_query("SELECT url AS \"originalUrl\", 200 AS status, 'text/html' AS mime, trim(html) AS string FROM pages")
def warc_roundtrip(spark, sf_dir):
    a = warc.from_files(spark, _written_warc(spark, sf_dir))
    return a.select("originalUrl", "status", "mime", string=StringContent(limit=0))


@_query("SELECT url AS \"originalUrl\", $TITLE_TEXT AS title FROM pages WHERE url LIKE '%/en/%'")
def warc_by_index(spark, sf_dir):
    a = warc.from_files_with_cdx(spark, _written_warc(spark, sf_dir), Config(text_limit=0)).filter("originalUrl like '%/en/%'")
    return a.select("originalUrl", title=TITLE)


_RAW_LINES = "(SELECT doc_id, unnest(string_split(coalesce(replace(text, chr(13), ''), ''), chr(10))) AS line FROM documents)"


def _written_raw(spark, sf_dir) -> str:
    """Files of whole texts, each line after its document's id."""
    path = scratch.path(spark, "raw")
    lines = F.transform(F.split(F.coalesce(F.regexp_replace("text", "\r", ""), F.lit("")), "\n"), lambda x: F.concat(F.col("doc_id").cast("string"), F.lit("\t"), x))
    _table(spark, sf_dir, "documents").select(F.array_join(lines, "\n").alias("value")).write.option("compression", "gzip").text(path)
    return path


@_query(f"SELECT doc_id, md5(line) AS line FROM {_RAW_LINES}")
def raw_files_lines(spark, sf_dir):
    found = files.files(spark, _written_raw(spark, sf_dir), [r".*\.txt\.gz"])
    lines = files.lines(found).select(F.col("value").alias("x")).filter(F.contains("x", F.lit("\t")))
    at = F.instr("x", "\t")
    return lines.select(F.substring("x", F.lit(1), at - 1).cast("long").alias("doc_id"), F.md5(F.substring("x", at + 1, F.length("x")).cast("binary")).alias("line"))


@_query(f"SELECT doc_id, count(*) AS n, sum(length(line))::BIGINT AS chars FROM {_RAW_LINES} GROUP BY doc_id")
def text_lines(spark, sf_dir):
    lines = files.text_lines(spark, _written_raw(spark, sf_dir))
    at = F.instr("value", "\t")
    rows = lines.select(F.substring("value", F.lit(1), at - 1).cast("long").alias("doc_id"), (F.length("value") - at).alias("c"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))


@_query("SELECT count(*) AS n, sum(page_id)::BIGINT AS ids FROM pages")
def text_files(spark, sf_dir):
    path = scratch.path(spark, "texts")
    _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("value")).write.text(path)
    found = files.text_files(spark, path).select(F.explode(F.split("value", "\n")).alias("x")).filter("x <> ''")
    return found.agg(F.count("*").alias("n"), F.sum(F.col("x").cast("long")).alias("ids"))


@_query("SELECT url AS \"originalUrl\", '20240101000000' AS timestamp, $TITLE_TEXT AS title, $BODY AS text FROM pages")
def title_text_tsv(spark, sf_dir):
    """The recipe of titles and texts: exported as tab-separated values and read again."""
    body = HtmlText().of(Html.first("body"))
    path = scratch.path(spark, "tsv")
    save_rows(_pages(spark, sf_dir).select("originalUrl", title=TITLE, text=body).select("originalUrl", F.lit("20240101000000").alias("timestamp"), "title", "text"), path)
    return spark.read.schema("originalUrl string, timestamp string, title string, text string").csv(path, sep="\t", escape='"')


@_query("SELECT count(*) AS n FROM pages")
def warc_count(spark, sf_dir):
    """Records written, as the writer counts them."""
    a = Archive(_responses(spark, sf_dir).withColumn("timestamp", F.lit("20240101000000")), ["page_id", "originalUrl", "timestamp"], root_func=HttpPayload())
    n = warc.save(a, scratch.path(spark, "warc"), created="2024-01-01T00:00:00Z")
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


@_query(f"SELECT n AS lines FROM (SELECT count(*) AS n FROM {_EDGES})")
def save_text_count(spark, sf_dir):
    n = save_text(_edges(spark, sf_dir).select(F.concat_ws("\t", "src", "dst").alias("value")), scratch.path(spark, "lines"))
    return spark.range(1).select(F.lit(n).cast("long").alias("lines"))


@_query("SELECT page_id, $TITLE_TEXT AS title FROM pages")
def to_dataframe(spark, sf_dir):
    rows = _pages(spark, sf_dir).enrich(TITLE).to_df()
    return rows.select("record.page_id", F.col("payload.string.html.title.text").alias("title"))


@_query("SELECT doc_id, coalesce(len(list_distinct(regexp_extract_all(text, '\\b(?:19|20)[0-9]{2}\\b'))), 0)::BIGINT AS years FROM documents")
def entities_years(spark, sf_dir):
    a = _documents(spark, sf_dir)
    e = Entities().of(Pointer("payload.string"))
    return a.select("doc_id", dates=e.get("dates")).select("doc_id", F.coalesce(F.size(F.filter("dates", lambda d: d.rlike("^(19|20)[0-9]{2}$"))), F.lit(0)).cast("long").alias("years"))


@_query(r"SELECT e AS value, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '\b(?:Apache License|Creative Commons|GNU|MIT)\b'))) AS e FROM documents) GROUP BY e")
def entities_counts(spark, sf_dir):
    licences = Entities(lambda: entities.gazetteer(("GNU", "MIT", "Apache License", "Creative Commons")))
    found = _documents(spark, sf_dir).flat_map_values(licences.of(Pointer("payload.string")).get("locations"))
    return found.groupBy("value").agg(F.count("*").alias("n"))


@_query("SELECT d.doc_id, d.doc_id % 3 = 0 AS was_revisit, f.first AS \"offset\" FROM documents d JOIN (SELECT md5(text) AS g, min(doc_id) FILTER (doc_id % 3 <> 0) AS first FROM documents GROUP BY 1) f ON md5(d.text) = f.g WHERE d.doc_id % 3 = 0 AND f.first IS NOT NULL")
def revisits_resolved(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    c = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "warc/revisit").otherwise("text/plain").alias("mime"), F.md5(F.col("text").cast("binary")).alias("digest"), F.format_string("%014d", "doc_id").alias("timestamp"), F.lit("f").alias("filename"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("offset"), F.lit(1).alias("compressedSize"))
    return revisits.resolved(c).filter("mime = 'warc/revisit' and offset is not null").select("doc_id", (F.col("doc_id") % 3 == 0).alias("was_revisit"), "offset")
