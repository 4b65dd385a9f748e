"""Page trees, density and records on small pages worked by hand."""

import math

from pyspark.sql import functions as F

from gleaner.functions.tree import title_node
from gleaner.operators import density as C
from gleaner.operators import dom as D
from gleaner.operators import records as W


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def tree(html):
    return [(n["node_id"], n["parent_id"], n["last_id"], n["tag"], n["text"], n["tail"]) for n in D.parse(html)]


def test_implied_ends_and_tails():
    assert tree("<div>a<p>b<br>c<p>d</div>e") == [
        (1, None, 5, "html", "", ""), (2, 1, 5, "div", "a", "e"), (3, 2, 4, "p", "b", ""), (4, 3, 4, "br", "", "c"), (5, 2, 5, "p", "d", "")]
    assert [n[3] for n in tree("<ul><li>a<li><ul><li>b</ul><li>c</ul>")] == ["html", "ul", "li", "li", "ul", "li", "li"]
    assert [(n[3], n[1]) for n in tree("<p><b>x<p>y</b>z")] == [("html", None), ("p", 1), ("b", 2), ("p", 1)]
    assert tree(None) == tree("") == []
    assert len(tree("<div>" * 5000 + "x")) >= 1


def test_trees_hold_together(spark, sf):
    rows = D.nodes(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], {})[r["node_id"]] = r
    for nodes in by.values():
        for r in nodes.values():
            assert r["last_id"] >= r["node_id"] and (r["content"] is None or len(r["content"]) == r["content_length"])
            if r["parent_id"] is not None:
                p = nodes[r["parent_id"]]
                assert p["node_id"] < r["node_id"] <= r["last_id"] <= p["last_id"] and p["depth"] == r["depth"] - 1


def test_node_helpers(spark):
    source = pages(spark, "<html><head><title>A b</title></head><body><h1 id='x'>One A b</h1><p>two <b>three</b> four</p><strong>A</strong></body></html>")
    d, whole = D.nodes(source), D.structure(source)
    assert [r["xpath"] for r in whole.orderBy("node_id").collect()][-1] == "/html[1]/body[1]/strong[1]"
    assert {r["own"] for r in D.own_text(d).collect()} >= {"two four", "three"}
    t = D.title_nodes(d).collect()
    assert [(r["content"], r["lcs"]) for r in t] == [("one a b", 2)]
    assert [r["headlines"] for r in D.headlines(d).collect()] == ["one a b"]
    assert D.by_attr(d, "id", "x", "h1").count() == 1 and D.by_attr(d, "id").count() == 1 and D.by_attr(d, "id", "y").count() == 0
    assert whole.where("node_id = 1").first()["height"] == 4
    assert whole.where("xpath like '%/p[1]'").first()["lines"] == "two\nthree four"
    assert D.rejected(pages(spark, "<p>x", "", None), D.nodes(pages(spark, "<p>x", "", None))).count() == 2


def test_density(spark):
    text = "word " * 60
    d = pages(spark, f"<html><body><div><a href='/a'>link one</a> <a href='/b'>link two</a></div><div><p>{text}</p><p>{text}</p></div><div></div></body></html>")
    s = {r["node_id"]: r for r in C.marked(d).collect()}
    body = min(s)
    assert s[body]["linkchar_num"] == len("link one") + len("link two")
    assert s[body]["char_num"] == max(r["char_num"] for r in s.values())
    para = C.article(d).first()["para"]
    assert "word word" in para and "link one" not in para
    rows = C.marked(d).collect()
    assert {r["mark"] for r in rows} == {0, 1, 2}
    columns = C.marked(d).select("text_density", C.density(*(F.col(c) for c in ("char_num", "tag_num", "linkchar_num", "linktag_num", "ratio"))).alias("d")).collect()
    assert all(math.isclose(r["text_density"], r["d"], rel_tol=1e-9, abs_tol=1e-9) for r in columns)
    for r in rows:  # the closed form, by hand
        c, t, lc, lt = r["char_num"], max(1, r["tag_num"]), max(1, r["linkchar_num"]), max(1, r["linktag_num"])
        u = max(1, c - r["linkchar_num"])
        want = 0 if not c else c / t * math.log(c / lc * t / lt) / math.log(math.log(c * lc / u + r["ratio"] * c + math.e))
        assert math.isclose(r["text_density"], want, rel_tol=1e-9, abs_tol=1e-9)


def test_records(spark):
    item = "<div class=r><h2>t</h2><p>some words here {}</p></div>"
    odd = "<div class=r><table><tr><td>x</td><td>y</td></tr></table></div>"
    d = pages(spark, "<html><body><section>" + item.format(1) + item.format(2) + odd + item.format(3) + "</section><section>" + "".join(f"<li><a href='/{k}'>go {k}</a></li>" for k in range(4)) + "</section></body></html>")
    for variant in W.VARIANTS:
        m = W.measured(d, variant).collect()
        assert any(r["valid"] for r in m) and any(r["all_links"] for r in m), variant
    c = W.clusters(d)
    assert c.where("repaired").count() == 1  # the odd one between similar ones
    assert "some words here 1" in W.article(d).first()["para"] and "go 1" not in W.article(d).first()["para"]
    assert c.groupBy("cluster").count().where("count = 4").count() == 2  # all of a segment are one cluster


def test_one_cluster_for_a_segment_and_its_ends(spark):
    a, b, c = "<div><p>x {}</p></div>", "<div><ul><li>y</li><li>z {}</li></ul></div>", "<div><table><tr><td>q</td></tr></table></div>"
    two = D.parse("<html><body><section>" + (a + a + b + b).format(1, 2, 3, 4) + "</section></body></html>")
    nodes, found, repaired = W.clustered(two)
    assert [len(x) for x in found.values()] == [4] and not repaired
    ends = D.parse("<html><body><section>" + c + (a + a).format(1, 2) + "<div><dl><dt>q</dt><dd><ul><li>z</li></ul></dd></dl></div>" + "</section></body></html>")
    nodes, found, repaired = W.clustered(ends)
    assert [len(x) for x in found.values()] == [4] and len(repaired) == 2


def test_deep_trees_stay_small(spark):
    d = D.nodes(pages(spark, "<div>" * 3000 + "text"), clean=False)
    assert d.count() > 2000 and d.selectExpr("sum(length(to_json(struct(*))))").first()[0] < 800_000


def test_comments_are_no_article(spark):
    one = "<div>" + "".join(f"<a href='/{k}'>{w}</a>" for k, w in enumerate(("reply", "like", "user"))) + "<p>first words</p><p>second words</p></div>"
    d = pages(spark, f"<html><body><section>{one}{one}{one}</section></body></html>")
    assert [r["comments"] for r in W.measured(d).collect()] == [True]


def test_no_pages(spark):
    d = pages(spark, "").where("false")
    assert C.article(d).count() == W.article(d).count() == D.title_nodes(D.nodes(d)).count() == 0


def test_title_nodes_both_ways(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    one = D.trees(p, lambda tree: [(t[0]["node_id"], t[1]) for t in [title_node(tree)] if t], "node_id int, lcs int")
    assert sorted(tuple(r) for r in one.collect()) == sorted((r["page_id"], r["node_id"], r["lcs"]) for r in D.title_nodes(D.nodes(p)).collect())


def test_changing_trees(spark):
    from gleaner.functions import tree as T

    t = T.parse("<div id=a><p class=x>one<b>two</b>three</p><script>no</script><p>four</p></div>")
    tags = lambda nodes: [n["tag"] for n in nodes]
    assert tags(T.without(t, lambda n: n["attrs"].get("class") == "x")) == ["html", "div", "script", "p"]
    new = T.changed(t, lambda n: n["tag"] == "div", attrs={"id": None, "role": "main"}, text="new")
    assert [(n["attrs"], n["text"]) for n in new if n["tag"] == "div"] == [({"role": "main"}, "new")] and t[1]["attrs"] == {"id": "a"}
    flat = T.unwrapped(t, lambda n: n["tag"] in ("p", "div"))
    assert [(n["tag"], n["parent_id"], n["depth"]) for n in flat] == [("html", None, 1), ("b", 1, 2), ("script", 1, 2)]


def test_links_of_records(spark):
    html = "<html><body><ul>" + "".join(f"<li>text {k} <a href='/{k}'>go {k}</a></li>" for k in range(3)) + "</ul><a href='/no'>out</a></body></html>"
    got = W.links(pages(spark, html)).orderBy("node_id").collect()
    assert [(r["href"], r["anchor"]) for r in got] == [(f"/{k}", f"go {k}") for k in range(3)] and len({r["cluster"] for r in got}) == 1
