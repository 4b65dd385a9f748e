"""Main text by repeated records: clusters of similar siblings, worked out where a page is parsed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.tree import body_of, ends, title_node
from . import dom as D

#: Tags that a subtree's listing leaves out, and tags that need no partner.
_SKIP, _FREE = ("em", "b", "i", "br", "img"), {"em", "b", "br", "i", "font"}
VARIANTS = ("right_siblings", "next_four", "same_tag")


def _signature(nodes: list[tuple]) -> tuple[set, set, set]:
    """Of (depth, tag): tags, levels, tags by level; links and inline tags are looked through."""
    seen = [(d, t) for d, t in nodes if t not in _SKIP and t != "a"]
    return {t for _, t in seen}, {d for d, _ in seen}, set(seen)


def similar(tag_a: str, a: tuple, tag_b: str, b: tuple) -> bool:
    return tag_a == tag_b and abs(len(a[0]) - len(b[0])) <= 1 and abs(len(a[1]) - len(b[1])) <= 1 and a[0] - _FREE <= b[0] and abs(len(a[2]) - len(b[2])) <= 1


def clustered(tree: list[dict], variant: str = "right_siblings") -> tuple[list[dict], dict[int, list[int]], set[int]]:
    """The body below its root; clusters of places in it, by the first place; places that were repaired.

    Levels from the top; nothing below a record is looked at. Siblings of one parent and tag are a segment, and what
    is similar in it is marked and forms one cluster, named after its first node. Variants compare with the next four
    of the level, or with the level's nodes of the tag up to the first match, and a cluster is what matches hang together. Then an unmarked sibling without records below,
    between two records (at the ends of its segment: beside one), becomes a record of all clusters of its level and tag."""
    b = [n for n in body_of(tree) if n["tag"] not in ("body", "html")]
    end, depth, tag, parent = ends(b), [n["depth"] for n in b], [n["tag"] for n in b], [n["parent_id"] for n in b]
    sig: dict[int, tuple] = {}

    def alike(i: int, j: int) -> bool:
        for k in (i, j):
            if k not in sig:
                sig[k] = _signature([(depth[x] - depth[k], tag[x]) for x in range(k, end[k])])
        return similar(tag[i], sig[i], tag[j], sig[j])

    # Siblings of one kind of subtree are compared once: what a signature is alike to hangs on nothing else.
    known: dict[tuple, bool] = {}

    def same(i: int, j: int) -> bool:
        if i not in sig or j not in sig:
            alike(i, j)
        key = (tag[i], tag[j], frozenset(sig[i][2]), frozenset(sig[j][2]))
        if key not in known:
            known[key] = alike(i, j)
        return known[key]

    clusters: dict[int, list[int]] = {}
    marked, blocked, repaired = [False] * len(b), [False] * len(b), set()
    levels: dict[int, list[int]] = {}
    for i, d in enumerate(depth):
        levels.setdefault(d, []).append(i)
    for level in sorted(levels):
        here = [i for i in levels[level] if not blocked[i]]
        segments: dict[tuple, list[int]] = {}
        for i in here:
            segments.setdefault((parent[i], tag[i]), []).append(i)
        if variant == "right_siblings":
            for g in segments.values():
                own: dict[int, None] = {}
                for x in range(1, len(g)):
                    if marked[g[x]]:
                        continue
                    for j in g[x:]:
                        if same(g[x - 1], j):
                            own.setdefault(g[x - 1])
                            own.setdefault(j)
                            marked[g[x - 1]] = marked[j] = True
                if own:
                    clusters[min(own)] = sorted(own)
        else:
            of: dict[int, int] = {}
            groups: dict[str, list[int]] = {}
            for i in here:
                groups.setdefault(tag[i] if variant == "same_tag" else "", []).append(i)
            for g in groups.values():
                for x, i in enumerate(g):
                    for j in g[x + 1 :] if variant == "same_tag" else g[x + 1 : x + 5]:
                        if j not in of and same(i, j):
                            of[j] = of.setdefault(i, i)
                            if variant == "same_tag":
                                break
            for i, first in of.items():
                marked[i] = True
                clusters.setdefault(first, []).append(i)
        for g in segments.values():
            for x, i in enumerate(g):
                near = [marked[g[y]] for y in (x - 1, x + 1) if 0 <= y < len(g)]
                if not marked[i] and near and all(near):
                    marked[i] = True
                    repaired.add(i)
                    for first, own in clusters.items():
                        if depth[first] == level and tag[first] == tag[i]:
                            own.append(i)
        for i in here:
            if marked[i]:
                blocked[i + 1 : end[i]] = [True] * (end[i] - i - 1)
    return b, {k: sorted(v) for k, v in clusters.items()}, repaired


def judged(b: list[dict], clusters: dict[int, list[int]]) -> dict[int, tuple[int, int, bool, bool, bool]]:
    """(records, characters, all links, comments, valid) of each cluster.

    All links: there is no text but that of links, or twice as much of links. Comments: two records or more, each with
    three texts of links and two others, and two texts of links that every record has."""
    end, place = ends(b), {n["node_id"]: k for k, n in enumerate(b)}
    linked = []
    for n in b:
        linked.append(n["tag"] == "a" or n["parent_id"] in place and linked[place[n["parent_id"]]])
    out = {}
    for first, own in clusters.items():
        n_text, l_chars, o_chars, rich, shared = 0, 0, 0, True, {}
        for i in own:
            n_text += b[i]["content_length"]
            a = o = 0
            for k in range(i, end[i]):
                text = b[k]["text"]
                if not text or b[k]["tag"] in ("em", "strong", "span", "i", "b"):
                    continue
                if linked[k]:
                    a, l_chars = a + 1, l_chars + len(text)
                    if text.strip("0123456789."):
                        shared[text] = shared.get(text, 0) + 1
                else:
                    o, o_chars = o + 1, o_chars + len(text)
            rich = rich and a >= 3 and o >= 2
        links = o_chars == 0 or l_chars / o_chars > 2.0
        comments = len(own) >= 2 and rich and sum(n == len(own) for n in shared.values()) >= 2
        out[first] = len(own), n_text, links, comments, not links and not comments
    return out


def clusters(pages: DataFrame, variant: str = "right_siblings") -> DataFrame:
    """(page_id, cluster, node_id, repaired): records of each page's body, named after their cluster's first node."""

    def rows(tree: list[dict]):
        b, found, repaired = clustered(tree, variant)
        for first, own in found.items():
            yield from ((b[first]["node_id"], b[i]["node_id"], i in repaired) for i in own)

    return D.trees(pages, rows, "cluster int, node_id int, repaired boolean")


def measured(pages: DataFrame, variant: str = "right_siblings") -> DataFrame:
    """(page_id, cluster, n_records, n_text, all_links, comments, valid)."""

    def rows(tree: list[dict]):
        b, found, _ = clustered(tree, variant)
        for first, values in judged(b, found).items():
            yield (b[first]["node_id"], *values)

    return D.trees(pages, rows, "cluster int, n_records int, n_text int, all_links boolean, comments boolean, valid boolean")


def links(pages: DataFrame, variant: str = "right_siblings", valid: bool = False) -> DataFrame:
    """(page_id, cluster, node_id, href, anchor): links within the records of each cluster (or of valid ones), once for each."""

    def rows(tree: list[dict]):
        b, found, _ = clustered(tree, variant)
        end, good = ends(b), judged(b, found)
        for first, own in found.items():
            if not valid or good[first][4]:
                at = sorted({k for i in own for k in range(i, end[i]) if b[k]["tag"] == "a" and b[k]["attrs"].get("href")})
                yield from ((b[first]["node_id"], b[k]["node_id"], b[k]["attrs"]["href"], b[k]["content"]) for k in at)

    return D.trees(pages, rows, "cluster int, node_id int, href string, anchor string")


def main_text(tree: list[dict], variant: str = "right_siblings") -> tuple[str, str]:
    """(title, para): text from the first to the last record of the valid cluster with most text (the first on a tie), from
    the title's node on if that comes before. Without such a cluster the title is the text."""
    b, found, _ = clustered(tree, variant)
    valid = [(-v[1], first) for first, v in judged(b, found).items() if v[4]]
    head = title_node(tree)
    title = head[0]["content"] if head else next((n["content"] for n in tree if n["tag"] == "title"), "")
    if not valid:
        return title, title
    own = found[min(valid)[1]]
    low, high = b[own[0]]["node_id"], max(b[i]["last_id"] for i in own)
    if head and head[0]["node_id"] < low:
        low = head[0]["node_id"]
    parts = (" ".join(x for x in (n["text"], n["tail"]) if x) for n in tree if low <= n["node_id"] <= high)
    return title, " ".join(x for x in parts if x)


def article(pages: DataFrame, keep: tuple[str, ...] = (), variant: str = "right_siblings") -> DataFrame:
    """(page_id, keep.., title, para) of pages (page_id, html) that have any element."""
    return D.trees(pages, lambda tree: [main_text(tree, variant)], "title string, para string", keep)


def documents(pages: DataFrame, skip_hubs: bool = False) -> DataFrame:
    """(page_id, base_url, title, meta, headlines, para) of pages that are large enough (and no hubs)."""
    p = pages.where(H.large_enough(F.col("html")))
    if skip_hubs:
        p = p.where(H.link_ratio(F.col("html")) <= 0.6)
    p = p.select("page_id", "html", F.col("url").alias("base_url"), H.meta(F.col("html"), "description").alias("meta"))

    def rows(tree: list[dict]):
        title, para = main_text(tree)
        heads = sorted((n["tag"], n["node_id"], n["content"]) for n in tree if n["tag"] in ("h1", "h2", "h3", "h4") and n["content"])
        return [(title, "\n".join(h[2] for h in heads), para)]

    return D.trees(p, rows, "title string, headlines string, para string", ("base_url", "meta")).select("page_id", "base_url", "title", "meta", "headlines", "para")


#: What compares extractions: a tree's main text by each way.
def extractions() -> dict[str, Callable[[list[dict]], str]]:
    from .density import main_text as by_density

    return {"density": by_density, "records": lambda tree: main_text(tree)[1]}


def compared(pages: DataFrame) -> DataFrame:
    """(page_id, method, para): three extractors side by side, in one pass: density, records, and tags cut off."""
    ways = extractions()
    p = pages.select("page_id", "html", H.normalize(H.strip_tags(H.clean(F.col("html")))).alias("tags"))
    both = D.trees(p, lambda tree: [tuple(f(tree) for f in ways.values())], ", ".join(f"{k} string" for k in ways), ("tags",))
    each = F.array(*(F.struct(F.lit(k).alias("method"), F.col(k).alias("para")) for k in (*ways, "tags")))
    return both.select("page_id", F.explode(each).alias("x")).select("page_id", "x.method", "x.para")
