"""Cleaning, links and URLs on cases worked by hand."""

from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions import urls as U
from gleaner.operators import links as L


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_cleaning(spark):
    html = "<HTML><!-- a\nb --><SCRIPT x>1 < 2</SCRIPT>T<style>p{}</style>e<noscript>n</noscript>x<fieldset>f</fieldset>t\n \n,\n\nend"
    assert one(spark, H.clean(F.col("h")), h=html) == "<html>textend"
    assert one(spark, H.clean(F.col("h"), lower=False), h="<P>A<script>x</script><SCRIPT>y</SCRIPT>") == "<P>A<SCRIPT>y</SCRIPT>"
    assert one(spark, H.clean(F.col("h")), h="a<!-- b --><!-- c -->d<script>never ends") == "ad<script>never ends"


def test_stripping(spark):
    assert one(spark, H.strip_tags(F.col("h")), h="a<b c='d'>e</b>f < g") == "aef < g"
    assert one(spark, H.strip_from(F.col("h")), h="junk<html><p>x</p>y<open") == "xy"
    assert one(spark, H.strip_from(F.col("h")), h="no root") == "t"


def test_normalised(spark):
    assert one(spark, H.normalize(F.col("t")), t="  a\t b \r\n \n  c  ") == "a b c"
    assert one(spark, H.normalize(F.col("t")), t=None) == ""
    assert one(spark, H.density_text(F.col("t")), t="a\tb\n c&nbsp;d e") == "abc;de"


def test_resolving(spark):
    base = "http://h.org/a/b?q=1"
    want = {"#x": None, "//k/p": "http://k/p", "/p": "http://h.org/p", "?z": "http://h.org/a/b?z", "c": "http://h.org/a/c", "../c": "http://h.org/c", "https://k": "https://k", None: None}
    for url, to in want.items():
        assert one(spark, U.resolve(F.col("u"), F.col("b")), u=url, b=base) == to
    assert one(spark, U.normalized(F.col("u"), F.col("b")), u="https://k", b=base) == "https://k/"
    assert one(spark, U.trim(F.col("u")), u=" \t\"'/p' \r\n") == "/p"


def test_resolving_as_the_library_does(spark):
    from urllib.parse import urljoin

    bases = ["http://h.org/a/b/c?q=1", "http://h.org", "http://h.org/x/"]
    urls = ["../e", "./f", "../../../g", "a/./b/../c", "..", ".", "/p/../q/./r", "x/..", "/..", "d?u=../v", "e#../w", "../h/?x", "k..l/..m", "/a/b"]
    df = spark.createDataFrame([(u, b) for u in urls for b in bases], "u string, b string")
    for r in df.select("u", "b", U.resolve(F.col("u"), F.col("b")).alias("got")).collect():
        assert r["got"] == urljoin(r["b"], r["u"]), r


def test_references_and_attributes(spark):
    from html import unescape

    for t in ("a&amp;b &lt;&gt; &eacute;&nbsp;&#65;&#x42;&#128512; &unknown; & &amp; &;", "none", "&amp;", "&#0;x&#xD800;"):
        want = unescape(t) if "#0" not in t else t
        assert one(spark, H.unescape(F.col("t")), t=t) == want
    page = """<META content='a "b" > c' name=description><meta name="keywords" lang=x content=one><meta property="og:title" content="T &amp; U"/>
      <meta data-name="description" content="no"><!-- <meta name="author" content="no"> --><meta http-equiv=refresh content="5"><meta content="v>w" x="a=b" name='Robots'><meta charset='UTF-8'>"""
    for by, value, want in (("name", "description", 'a "b" > c'), ("name", "keywords", "one"), ("property", "og:title", "T & U"), ("name", "author", ""), ("http-equiv", "refresh", "5"), ("name", "robots", "v>w"), ("name", "none", "")):
        assert one(spark, H.meta(F.col("h"), value, by), h=page) == want, value
    assert one(spark, H.charset(F.col("h")), h=page) == "utf-8"
    ratio = "<html><head>x</head><body><a href=1>ab</a><button>cd</button><select><option>ef</option></select>ghij<abbr>kl</abbr></body></html>"
    assert one(spark, H.link_ratio(F.col("h")), h=ratio) == 6 / 12


def test_links_of_real_pages(spark):
    """Quotes of all kinds, none, references, a comment, dot segments, attributes before, links that are never closed."""
    html = """<a href="/a?x=1&amp;y=2">A &amp; B</a><A class='q>"' HREF = '/b'>two</A><a href=/cc>bare</a><!-- <a href="/d">no</a> --><script>"<a href='/no'>"</script>
      <a title="href='/wrong'" href="../e">up</a><a data-href="/no" href="/f" >f<a name=none>n</a><a href="./g/../hh?u=../v">g<a href='/ii'>last"""
    rows = L.extract(spark.createDataFrame([(1, "http://h.org/p/q/r", html)], "page_id long, url string, html string")).orderBy("pos").collect()
    assert [r["url"] for r in rows] == [f"http://h.org{x}" for x in ("/a?x=1&y=2", "/b", "/cc", "/p/e", "/f", "/p/q/hh?u=../v", "/ii")]
    assert [r["anchor_text"] for r in rows] == ["a & b", "two", "bare", "up", "f", "g", "last"]


def test_parts_and_scope(spark):
    for url, parts in {"http://h.org/a/b?c": ("http", "h.org", "/a/b"), "mailto:x@y": ("mailto", "", ""), "rel/x": ("", "", ""), "ftp://h": ("ftp", "h", "")}.items():
        assert tuple(one(spark, f(F.col("u")), u=url) for f in (U.scheme, U.host, U.path)) == parts
    scope = U.in_scope(F.col("r"), F.col("u"), F.col("b"))
    for raw, url, ok in (("/x", "http://h/x", True), ("/tag/x", "http://h/tag/x", False), ("/x", "http://k/x", False), ("/", "http://h/", False), ("/x", "ftp://h/x", False)):
        assert one(spark, scope, r=raw, u=url, b="http://h/") is ok


def test_url_words(spark):
    assert one(spark, U.tokens(F.col("u")), u="http://www.Shop.com/Red%20shoes/12?x=%zz") == ["shop", "red", "20shoes", "12", "x", "zz"]
    assert one(spark, U.tokens(F.col("u")), u="http://www.shop.com/red%20shoes") == ["shop", "red", "shoes"]
    assert one(spark, U.char_ngrams(F.col("t")), t="abcd") == ["abc", "bcd"]
    assert one(spark, U.char_ngrams(F.col("t")), t="ab") == []


def test_links(spark):
    html = '<a href=" /one "><b>One</b> thing</a><a href="#top">up</a><a class=x href="http://k.org">K</a><a href="/one">again</a><a href="x">y</a>'
    rows = L.extract(spark.createDataFrame([(1, "http://h.org/p", html)], "page_id long, url string, html string")).collect()
    urls = [r["url"] for r in rows]
    assert "http://h.org/one" in urls and "http://k.org/" in urls and not any(u.endswith("#top") for u in urls)
    assert all(r["parent_url"] == "http://h.org/p" for r in rows)
