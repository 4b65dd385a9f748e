"""Pages: cleaning, metadata, links, URLs, hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..operators import links as L
from ..session import table
from . import query

_CLEAN = "lower(html)"
for _b in ("<!--.*?-->", "<script.*?>.*?</script>", "<noscript.*?>.*?</noscript>", "<style.*?>.*?</style>", "<fieldset.*?>.*?</fieldset>"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_b}', '', 'gs')"
_CLEAN = rf"regexp_replace({_CLEAN}, '[\r,\n]\s*\n+', '', 'g')"
_A = """(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>"""
_BODY = f"regexp_replace({_CLEAN}, '<head.*?</head>', '', 'gs')"
_LINKED = " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all({_BODY}, '(?is)<{t}(?:[ >][^>]*)?>(.*?)</{t}>', 1), lambda x: length(regexp_replace(x, '<[^>]+>', '', 'g')))), 0)" for t in ("a", "button", "select")).replace("(?:[ >][^>]*)?>", "(?:\\s[^>]*)?>")
_RATIO = f"round(({_LINKED}) / greatest(length(regexp_replace({_BODY}, '<[^>]+>', '', 'g')), 1), 9)"


def _norm(x: str) -> str:
    x = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '\t', ' ', 'g'), '[\r,\n]\s*[\n,\t]+', chr(10), 'g')"
    return rf"array_to_string(list_filter(list_transform(string_split({x}, ' '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ')"


def _links_sql() -> str:
    """Links as (page_id, base, href, url, anchor), one for each distinct page and URL: the first."""
    refs = lambda x: f"replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    return rf"""
ch AS (SELECT page_id, url, {_CLEAN} AS html FROM pages),
a AS (SELECT page_id, url AS base, {refs(f"unnest(regexp_extract_all(html, '{_A}', 1))")} AS raw, {refs(f"regexp_replace(unnest(regexp_extract_all(html, '{_A}', 2)), '<[^>]+>', '', 'g')")} AS anchor, generate_subscripts(regexp_extract_all(html, '{_A}', 1), 1) AS pos FROM ch),
t AS (SELECT page_id, base, trim(raw, chr(9) || chr(13) || chr(10) || ' "''') AS href, anchor, pos FROM a),
k AS (SELECT * FROM t WHERE length(href) >= 2 AND href[1] <> '#'),
r AS (SELECT *, regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) AS bs, regexp_extract(base, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS bh, regexp_extract(base, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS bp,
  regexp_extract(href, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) AS hs, regexp_extract(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS hh FROM k),
v AS (SELECT *, CASE WHEN hh <> '' OR hs <> '' THEN href WHEN href LIKE '//%' THEN bs || ':' || href WHEN href LIKE '/%' THEN bs || '://' || bh || href WHEN href LIKE '?%' THEN bs || '://' || bh || bp || href
  ELSE bs || '://' || bh || regexp_replace(CASE WHEN bp = '' THEN '/' ELSE bp END, '[^/]*$', '') || href END AS u0 FROM r),
w AS (SELECT *, CASE WHEN regexp_extract(u0, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) <> '' AND regexp_extract(u0, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN u0 || '/' ELSE u0 END AS url FROM v),
links AS (SELECT page_id, base, href, url, {_norm("anchor")} AS anchor, pos FROM w QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1)"""


@query(f"SELECT page_id, {_CLEAN} AS cleaned, length({_CLEAN}) AS n_chars FROM pages")
def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "pages").select("page_id", H.clean(F.col("html")).alias("cleaned"))
    return c.withColumn("n_chars", F.length("cleaned").cast("long"))


@query(_CLEAN.replace("lower(html)", "html", 1).join(["SELECT page_id, md5(", ") AS digest FROM pages"]))
def clean_html_cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(H.clean(F.col("html"), lower=False).cast("binary")).alias("digest"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS plain, CASE WHEN strpos(html, '<html') > 0 THEN regexp_replace(substring(html, strpos(html, '<html')), '<[^>]*>?', '', 'g') ELSE regexp_replace(right(html, 1), '<[^>]*>?', '', 'g') END AS from_html, CASE WHEN strpos(html, '<hr/><h2>') > 0 THEN regexp_replace(substring(html, strpos(html, '<hr/><h2>')), '<[^>]*>?', '', 'g') ELSE regexp_replace(right(html, 1), '<[^>]*>?', '', 'g') END AS from_rule FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", H.strip_tags(h).alias("plain"), H.strip_from(h).alias("from_html"), H.strip_from(h, "<hr/><h2>").alias("from_rule"))


@query(f"SELECT page_id, {_norm('html')} AS normal FROM pages")
def normalize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.normalize(F.col("html")).alias("normal"))


@query(r"SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '\t', ' ', 'g'), '[\r,\n]\s', '', 'g'), ' '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ') AS normal FROM pages")
def normalize_words_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.normalize(F.col("html"), keep_breaks=False).alias("normal"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query(f"""SELECT page_id, {_norm("regexp_extract(html, '(?is)<meta\\s+name=" + '"description"' + "\\s+content=" + '"([^"]*)"' + "', 1)")} AS description, {_norm("regexp_extract(html, '(?is)<meta\\s+name=" + '"keywords"' + "\\s+content=" + '"([^"]*)"' + "', 1)")} AS keywords, lower(regexp_extract(html, '(?is)<meta\\s+charset="([^"]*)"', 1)) AS charset FROM pages""")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", H.meta(h, "description").alias("description"), H.meta(h, "keywords").alias("keywords"), H.charset(h).alias("charset"))


_HEADS = "list_filter(list_concat(" + ", ".join("list_transform(regexp_extract_all({c}, '(?is)<h%d[^>]*>(.*?)</h%d>', 1), lambda y: {n})" % (k, k) for k in range(1, 5)) + "), lambda x: x <> '')"


@query(f"SELECT page_id, array_to_string({_HEADS.format(c=_CLEAN, n=_norm(chr(114) + 'egexp_replace(y, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')'))}, chr(10)) AS headlines FROM pages")
def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.headlines(H.clean(F.col("html"))).alias("headlines"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\t', '', 'g'), '[\r,\n]\s', '', 'g'), '&nbsp', '', 'g'), '\s+', '', 'g') AS dense FROM pages")
def page_density_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.density_text(F.col("html")).alias("dense"))


@query("SELECT page_id, strlen(html) >= 1024 AS large_enough FROM pages")
def page_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.large_enough(F.col("html")).alias("large_enough"))


@query(f"WITH {_links_sql()} SELECT page_id, base AS parent_url, url, anchor AS anchor_text, '' AS neigb_text, '1' AS label, 0.0::DOUBLE AS prob FROM links")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.extract(table(spark, sf_dir, "pages")).select("page_id", "parent_url", "url", "anchor_text", "neigb_text", "label", "prob")


@query(f"WITH {_links_sql()} SELECT page_id, href, url, md5(url) AS url_key FROM links")
def link_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.extract(table(spark, sf_dir, "pages")).select("page_id", "href", "url", U.key(F.col("url")).alias("url_key"))


_H = "regexp_extract({}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
_P = "regexp_extract({}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_S = "regexp_extract({}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)"
_SCOPE = f"NOT regexp_matches(href, 'tag|video') AND {_S.format('url')} IN ('http', 'https') AND {_H.format('url')} = {_H.format('base')} AND length({_P.format('url')}) > 1"


@query(f"WITH {_links_sql()} SELECT page_id, url FROM links WHERE {_SCOPE}")
def link_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.in_scope(L.extract(table(spark, sf_dir, "pages"))).select("page_id", "url")


@query(f"WITH {_links_sql()} SELECT url, min(page_id) AS first_page, count(*) AS n_pages FROM links WHERE url NOT IN (SELECT url FROM pages) GROUP BY url")
def link_dedupe_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return L.unseen(L.extract(pages), pages.select("url")).groupBy("url").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n_pages"))


@query(f"SELECT page_id, {_S.format('url')} AS scheme, {_H.format('url')} AS host, {_P.format('url')} AS path FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"))


_TOK = "list_filter(string_split_regex(lower(regexp_replace(url_decode(url), '[^a-zA-Z0-9]', ' ', 'g')), ' +'), lambda x: x <> '' AND x NOT IN ('http', 'https', 'www', 'com', 'cn', 'asp', 'ftp', 'net'))"


@query(f"SELECT page_id, array_to_string({_TOK}, ' ') AS tokens, array_to_string(string_split_regex(url, '\\W+'), ' ') AS words, regexp_replace(url, '[一-龥a-zA-Z0-9]+', '', 'g') AS rest FROM pages")
def url_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(U.tokens(u), " ").alias("tokens"), F.array_join(U.words(u), " ").alias("words"), U.without_words(u).alias("rest"))


@query(f"SELECT page_id, array_to_string(list_concat(flatten(list_transform(list_filter({_TOK}, lambda x: length(x) > 4), lambda x: list_transform(range(1, length(x) - 1), lambda i: substring(x, i, 3)))), {_TOK}), ' ') AS grams FROM pages")
def url_char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(U.tokens_with_ngrams(F.col("url")), " ").alias("grams"))


@query(f"WITH {_links_sql()} SELECT url, anchor FROM links WHERE length(anchor) > 5 AND regexp_matches(anchor, '[^0-9\\t\\n \\r]')")
def anchor_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.extract(table(spark, sf_dir, "pages")).where(U.worth_anchor(F.col("anchor_text"))).select("url", F.col("anchor_text").alias("anchor"))


@query(f"SELECT page_id, {_RATIO} AS link_ratio FROM pages")
def page_link_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.round(H.link_ratio(F.col("html")), 9).alias("link_ratio"))


@query(f"SELECT page_id, url, {_RATIO} AS link_ratio, {_RATIO} > 0.6 AS is_hub FROM pages")
def hub_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.round(H.link_ratio(F.col("html")), 9).alias("link_ratio"))
    return p.withColumn("is_hub", F.col("link_ratio") > 0.6)


@query(f"SELECT page_id, CASE WHEN {_RATIO} > 0.05 THEN 'links' ELSE 'content' END AS route, CASE WHEN {_RATIO} > 0.05 THEN len(regexp_extract_all({_CLEAN}, '{_A}', 1)) ELSE 0 END AS n_links, CASE WHEN {_RATIO} <= 0.05 THEN length(regexp_replace({_BODY}, '<[^>]+>', '', 'g')) ELSE 0 END AS n_chars FROM pages")
def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, hub = F.col("html"), F.col("r") > 0.05
    p = table(spark, sf_dir, "pages").withColumn("r", F.round(H.link_ratio(h), 9))
    return p.select("page_id", F.when(hub, "links").otherwise("content").alias("route"), F.when(hub, F.size(H.hrefs(H.clean(h)))).otherwise(0).cast("long").alias("n_links"), F.when(~hub, F.length(H.strip_tags(H.body(h)))).otherwise(0).cast("long").alias("n_chars"))


@query("SELECT page_id, split_part(url || chr(10) || html, chr(10), 1) AS url, substring(url || chr(10) || html, length(url) + 2) AS html FROM pages")
def page_file_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page file's form, URL line and HTML, put together and split again."""
    v = F.concat_ws("\n", "url", "html")
    return table(spark, sf_dir, "pages").select("page_id", F.split(v, "\n", 2)[0].alias("url"), F.split(v, "\n", 2)[1].alias("html"))




@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, url, strlen(html)::BIGINT AS size FROM pages")
def document_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines and parsed again by their schema."""
    j = table(spark, sf_dir, "pages").select("page_id", F.to_json(F.struct(H.title(F.col("html")).alias("title"), "url", F.octet_length("html").cast("long").alias("size"))).alias("j"))
    return j.select("page_id", F.from_json("j", "title string, url string, size long").alias("d")).select("page_id", "d.*")


def _esc(x: str) -> str:
    return f"""replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


@query(f"""SELECT page_id, '<html><head><title>' || {_esc("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} || '</title><meta name="description" content=""/><base href="' || {_esc('url')} || '"/></head><body><h2>a</h2><h2>b</h2><div>' || {_esc("regexp_replace(html, '<[^>]+>', '', 'g')")} || '</div></body></html>' AS page FROM pages""")
def simplified_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", H.simplified(H.title(h), F.lit(""), F.col("url"), F.lit("a\n\nb"), H.strip_tags(h)).alias("page"))


@query(r"""SELECT page_id, regexp_replace('/html/body[1]/div[' || page_id || ']/p[3]', '\[\d+\]', '', 'g') AS path, coalesce(try_cast(regexp_extract('div[' || page_id || ']', '\[(\d+)\]', 1) AS INTEGER), 0) AS place, strpos(html, '<h1') - 1 AS at, regexp_matches(CAST(page_id AS VARCHAR) || '.5', '^[0-9.]*$') AS digits, starts_with(url, 'https') AS secure FROM pages""")
def path_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select("page_id", T.simple_path(F.concat(F.lit("/html/body[1]/div["), p, F.lit("]/p[3]"))).alias("path"), T.place(F.concat(F.lit("div["), p, F.lit("]"))).alias("place"), T.index_of(F.col("html"), "<h1").cast("long").alias("at"), F.concat(p, F.lit(".5")).rlike("^[0-9.]*$").alias("digits"), F.col("url").startswith("https").alias("secure"))
