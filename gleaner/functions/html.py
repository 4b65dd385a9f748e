"""HTML as text: cleaning, stripping, titles, metadata, links, by regular expressions that run in the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What cleaning deletes, in this order.
BLOCKS = ("(?s)<!--.*?-->", "(?s)<script.*?>.*?</script>", "(?s)<noscript.*?>.*?</noscript>", "(?s)<style.*?>.*?</style>", "(?s)<fieldset.*?>.*?</fieldset>")
#: The comma belongs to the class.
BLANK_LINES = r"[\r,\n]\s*\n+"
TAG = "<[^>]+>"
#: Of a start tag, what stands between its name and its end: quoted values may hold any character.
_INSIDE = r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
_VALUE = r"""("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
#: A link's attributes and what it holds: to its end, or to the next link, as links don't nest.
ANCHOR = rf"(?is)<a(?=[\s/>]){_INSIDE}(.*?)(?=</a\s*+>|<a[\s/>]|\z)"
LINKED = rf"(?is)<(a|button|select)(?=[\s/>]){_INSIDE}(.*?)</\1\s*+>"
META = rf"(?is)<meta(?=[\s/>]){_INSIDE}"


def clean(html: Column, lower: bool = True) -> Column:
    """Without comments, scripts, styles and field sets, and without blank lines; lower-case unless told otherwise."""
    out = F.lower(html) if lower else html
    for block in BLOCKS:
        out = F.regexp_replace(out, block, "")
    return F.regexp_replace(out, BLANK_LINES, "")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, TAG, "")


def strip_from(html: Column, start: str = "<html") -> Column:
    """Text outside tags from the first `start` on; without one, the last character."""
    at = F.locate(start, html)
    body = F.when(at > 0, F.substr(html, at)).otherwise(F.right(html, F.lit(1)))
    return F.regexp_replace(body, "<[^>]*>?", "")


def normalize(text: Column, keep_breaks: bool = True) -> Column:
    """Tabs as blanks, blank lines as one break (or none of them), words parted by one blank. Null: ''."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\t", " ")
    t = F.regexp_replace(t, r"[\r,\n]\s*[\n,\t]+", "\n") if keep_breaks else F.regexp_replace(t, r"[\r,\n]\s", "")
    return F.array_join(F.filter(F.transform(F.split(t, " "), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), " ")


def density_text(html: Column) -> Column:
    """Text without tabs, line ends, &nbsp and at last any white space."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"\t", ""), r"[\r,\n]\s", ""), "&nbsp", "")
    return F.regexp_replace(t, r"\s+", "")


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def unescape(text: Column) -> Column:
    """Character references read: numbers, and the names of HTML 4; others stay as they are."""
    one = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
    names = F.create_map(*(F.lit(x) for name, at in sorted(name2codepoint.items()) for x in (name, chr(at))), F.lit("apos"), F.lit("'"))
    char = lambda n: F.when((n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def read(ref: Column) -> Column:
        number = F.when(ref.rlike("^#[xX]"), F.conv(F.substr(ref, F.lit(3)), 16, 10).cast("long")).when(ref.startswith("#"), F.substr(ref, F.lit(2)).cast("long"))
        return F.coalesce(char(number), F.try_element_at(names, ref), F.concat(F.lit("&"), ref, F.lit(";")))

    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(one), 1), read), F.array(F.lit("")))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.zip_with(F.split(text, one, -1), found, lambda x, y: F.concat(x, y)), "")).otherwise(text)


def attr(inside: Column, name: str) -> Column:
    """The value of an attribute among a start tag's, whatever their order and quotes, with character references read;
    null where there is none."""
    other = r"""(?!%s[\s=])[^\s=>"'/]++(?:\s*+=\s*+%s)?+""" % (name, _VALUE.replace("(", "(?:", 1))
    raw = F.regexp_extract(inside, rf"(?is)^(?:[\s/]*+{other})*+[\s/]*+{name}\s*+=\s*+{_VALUE}", 1)
    bare = F.when(raw.rlike("^[\"']"), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.when(raw != "", unescape(bare))


def metas(html: Column) -> Column:
    """What stands inside the meta tags, comments left out."""
    return F.regexp_extract_all(F.regexp_replace(html, BLOCKS[0], ""), F.lit(META), 1)


def meta(html: Column, value: str, by: str = "name") -> Column:
    """Content of the first <meta> whose attribute `by` (name, property, http-equiv) is the value, normalised, or ''."""
    own = F.filter(metas(html), lambda x: F.lower(attr(x, by)) == value.lower())
    return normalize(attr(F.get(own, F.lit(0)), "content"))


def charset(html: Column) -> Column:
    own = F.filter(F.transform(metas(html), lambda x: attr(x, "charset")), lambda x: x.isNotNull())
    return F.lower(F.coalesce(F.get(own, F.lit(0)), F.lit("")))


def headlines(html: Column) -> Column:
    """Texts of h1, then h2, h3 and h4, by lines."""
    each = [F.transform(F.regexp_extract_all(html, F.lit(f"(?is)<h{k}[^>]*>(.*?)</h{k}>"), 1), lambda x: normalize(strip_tags(x))) for k in range(1, 5)]
    return F.array_join(F.filter(F.concat(*each), lambda x: x != ""), "\n")


def anchors(html: Column) -> Column:
    """Array of (href, anchor) of the links of cleaned HTML that have a reference, in order; anchor keeps its tags."""
    inside, held = (F.regexp_extract_all(html, F.lit(ANCHOR), k) for k in (1, 2))
    return F.filter(F.zip_with(inside, held, lambda i, h: F.struct(attr(i, "href").alias("href"), h.alias("anchor"))), lambda x: x["href"].isNotNull())


def hrefs(html: Column) -> Column:
    return F.transform(anchors(html), lambda x: x["href"])


def body(html: Column) -> Column:
    return F.regexp_replace(clean(html), "(?s)<head.*?</head>", "")


def link_ratio(html: Column) -> Column:
    """Characters of the texts of links, buttons and selections over those of the body's text."""
    b = body(html)
    linked = F.aggregate(F.regexp_extract_all(b, F.lit(LINKED), 3), F.lit(0), lambda z, x: z + F.length(strip_tags(x)))
    return linked / F.greatest(F.length(strip_tags(b)), F.lit(1))


def large_enough(html: Column, least: int = 1_024) -> Column:
    return F.octet_length(html) >= least


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def simplified(title_: Column, meta_: Column, base: Column, heads: Column, para: Column) -> Column:
    """A plain page of a document's parts."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), escape(c), F.lit(f"</{name}>"))
    h2 = F.array_join(F.transform(F.filter(F.split(heads, "\n"), lambda x: x != ""), lambda x: tag("h2", x)), "")
    return F.concat(F.lit("<html><head>"), tag("title", title_), F.lit('<meta name="description" content="'), escape(meta_), F.lit('"/><base href="'), escape(base), F.lit('"/></head><body>'), h2, tag("div", para), F.lit("</body></html>"))
