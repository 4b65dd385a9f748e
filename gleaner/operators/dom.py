"""Pages as tables of nodes.

dom_nodes: page_id, node_id (pre-order, root 1), parent_id, last_id (last node of the subtree), depth, sib_idx, tag, attrs,
text, tail, content_length (of the subtree's normalised text), content (that text, of titles, headings, links and strong
text only). A subtree is node_id BETWEEN a.node_id AND a.last_id. What needs a whole tree at once is worked out where a
page is parsed, in one pass over the pages and without an exchange (trees())."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import lcs_within, title_words
from ..functions.tree import body_of, ends, kids, norm, parse, title_node  # noqa: F401

SCHEMA = "page_id long, node_id int, parent_id int, last_id int, depth int, sib_idx int, tag string, attrs map<string,string>, text string, tail string, content_length int, content string"
#: Letters that a worker holds as rows of pages before it hands them on, and rows likewise.
LETTERS, ROWS = 1 << 20, 1 << 12


def trees(pages: DataFrame, rows: Callable[[list[dict]], Iterable[tuple]], schema: str, keep: tuple[str, ...] = (), clean: bool = True) -> DataFrame:
    """rows(tree) of each page (page_id, html), behind its page_id and the columns in keep: (page_id, keep.., schema..). Pages
    are cleaned first in the JVM; those without any element have no rows. Rows leave a worker by stretches, however many pages
    a batch has."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    p = pages.select("page_id", *keep, (H.clean(F.col("html")) if clean else F.col("html")).alias("html"))
    whole = StructType([*p.drop("html").schema.fields, *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(whole)

    def handed(b: pa.RecordBatch, owner: list[int], out: list[tuple]) -> pa.RecordBatch:
        kept = [b.column(c).take(pa.array(owner)) for c in range(b.num_columns - 1)]
        made = [pa.array(list(v), f.type) for v, f in zip(zip(*out), list(arrow)[len(kept) :])]
        return pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip([*kept, *made], arrow)], schema=arrow)

    def run(batches):
        for b in batches:
            html, owner, out, held = b.column(b.num_columns - 1), [], [], 0
            for k in range(b.num_rows):
                if tree := parse(html[k].as_py()):
                    for row in rows(tree):
                        owner.append(k)
                        out.append(row)
                        held += sum(len(x) for x in row if isinstance(x, str))
                        if held >= LETTERS or len(out) >= ROWS:
                            yield handed(b, owner, out)
                            owner, out, held = [], [], 0
            if out:
                yield handed(b, owner, out)

    return p.mapInArrow(run, whole)


def nodes(pages: DataFrame, clean: bool = True) -> DataFrame:
    """dom_nodes of pages (page_id, html). Pages without any element have no rows."""
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]

    def rows(tree: list[dict]):
        for n in tree:
            yield tuple(list(n["attrs"].items()) if c == "attrs" else n[c] for c in names)

    return trees(pages, rows, SCHEMA.split(", ", 1)[1], clean=clean)


def rejected(pages: DataFrame, dom: DataFrame) -> DataFrame:
    return pages.join(dom.select("page_id").distinct(), "page_id", "left_anti")


def by_tag(dom: DataFrame, *tags: str) -> DataFrame:
    return dom.where(F.col("tag").isin(*tags))


def by_attr(dom: DataFrame, name: str, value: str | None = None, tag: str | None = None) -> DataFrame:
    d = dom.where(F.col("attrs").getItem(name).isNotNull() if value is None else F.col("attrs").getItem(name) == value)
    return d.where(F.col("tag") == tag) if tag else d


def attr(name: str) -> Column:
    return F.coalesce(F.col("attrs").getItem(name), F.lit(""))


def children(dom: DataFrame) -> DataFrame:
    return dom.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children")).where("node_id is not null")


def flags(dom: DataFrame) -> DataFrame:
    """dom with n_children, has_child, no_text, no_tail, no_content, nested, text and content lengths."""
    d = dom.join(children(dom), ["page_id", "node_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return d.withColumns({"has_child": F.col("n_children") > 0, "no_text": F.length("text") == 0, "no_tail": F.length("tail") == 0, "no_content": F.col("content_length") == 0, "nested": F.col("last_id") > F.col("node_id"), "text_length": F.length("text")})


def own_text(dom: DataFrame) -> DataFrame:
    """(page_id, node_id, own): a node's text and its children's tails, in order."""
    tails = dom.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "tail"))), lambda x: x["tail"]), " ").alias("tails"))
    return dom.join(tails, ["page_id", "node_id"], "left").select("page_id", "node_id", F.trim(F.concat_ws(" ", "text", "tails")).alias("own"))


def _joined(parts: Iterable[str], by: str) -> str:
    return by.join(x for x in parts if x)


def structure(pages: DataFrame) -> DataFrame:
    """(page_id, node_id, height, xpath, lines) of each node: levels of its subtree, the path to it, and the texts of the
    subtree by lines, tails behind blanks."""

    def rows(tree: list[dict]):
        place, end = {n["node_id"]: k for k, n in enumerate(tree)}, ends(tree)
        path: list[str] = []
        for k, n in enumerate(tree):
            above = path[place[n["parent_id"]]] if n["parent_id"] in place else ""
            path.append(f"{above}/{n['tag']}[{n['sib_idx']}]")
            below = tree[k : end[k]]
            inner = (x["text"] if x is n else _joined((x["text"], x["tail"]), " ") for x in below)
            yield n["node_id"], max(x["depth"] for x in below) - n["depth"] + 1, path[k], _joined(inner, "\n")

    return trees(pages, rows, "node_id int, height int, xpath string, lines string")


def paths(pages: DataFrame) -> DataFrame:
    """(page_id, node_id, xpath) of each node, as structure() has them, without the texts below."""

    def rows(tree: list[dict]):
        path: dict[int, str] = {}
        for n in tree:
            path[n["node_id"]] = f"{path.get(n['parent_id'], '')}/{n['tag']}[{n['sib_idx']}]"
            yield n["node_id"], path[n["node_id"]]

    return trees(pages, rows, "node_id int, xpath string")


def body(dom: DataFrame) -> DataFrame:
    """Nodes of each page's body (of the whole tree where it has none)."""
    top = dom.groupBy("page_id").agg(F.coalesce(F.min(F.when(F.col("tag") == "body", F.col("node_id"))), F.lit(1)).alias("body"), F.min_by("last_id", F.when(F.col("tag") == "body", F.col("node_id"))).alias("last"))
    return dom.join(top, "page_id").where((F.col("node_id") >= F.col("body")) & (F.col("node_id") <= F.coalesce("last", F.lit(2**31 - 1))))


def headlines(dom: DataFrame) -> DataFrame:
    h = by_tag(dom, "h1", "h2", "h3", "h4").where(F.length("content") > 0)
    g = h.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("tag", "node_id", "content"))).alias("h"))
    return g.select("page_id", F.transform("h", lambda x: x["content"]).alias("list"), F.array_join(F.transform("h", lambda x: x["content"]), "\n").alias("headlines"))


def title_nodes(dom: DataFrame) -> DataFrame:
    """(page_id, node_id, content, lcs): of headings and strong text with at most one child, what shares most words in order
    with the page's title; the first on a tie. Titles of fewer than 2 characters have none."""
    title = by_tag(dom, "title").groupBy("page_id").agg(F.min_by("content", "node_id").alias("title")).where(F.length("title") >= 2)
    c = flags(body(by_tag(dom, "body", "html", "h1", "h2", "h3", "h4", "strong"))).where(F.col("tag").isin("h1", "h2", "h3", "h4", "strong") & (F.col("n_children") <= 1) & (F.length("content") > 0))
    s = c.join(title, "page_id").select("page_id", "node_id", "content", lcs_within(title_words(F.col("content")), title_words(F.col("title"))).alias("lcs")).where("lcs >= 1")
    best = s.groupBy("page_id").agg(F.min(F.struct((-F.col("lcs")).alias("l"), "node_id", "content")).alias("b"))
    return best.select("page_id", "b.node_id", "b.content", (-F.col("b.l")).alias("lcs"))


def neighbour_text(dom: DataFrame) -> DataFrame:
    """(page_id, node_id, href, near): a link's nearest text within two levels above it."""
    t = own_text(dom).join(dom.select("page_id", "node_id", "parent_id"), ["page_id", "node_id"])
    a = by_tag(dom, "a").select("page_id", "node_id", attr("href").alias("href"), F.col("parent_id").alias("p"))
    p = t.select("page_id", F.col("node_id").alias("p"), F.nullif("own", F.lit("")).alias("pt"), F.col("parent_id").alias("g"))
    g = t.select("page_id", F.col("node_id").alias("g"), F.nullif("own", F.lit("")).alias("gt"))
    return a.join(p, ["page_id", "p"], "left").join(g, ["page_id", "g"], "left").select("page_id", "node_id", "href", F.coalesce("pt", "gt", F.lit("")).alias("near"))
