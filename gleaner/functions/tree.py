"""A page's HTML as a list of nodes in pre-order, and what is read off one such list. No DataFrames here."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from html.parser import HTMLParser

from .text import common, plain_title_words

VOID = frozenset("br img hr input meta link base area col embed source track wbr param".split())
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Tags whose whole text the table of nodes keeps.
TEXTS = frozenset(("title", "h1", "h2", "h3", "h4", "strong", "a"))


def norm(text: str | None) -> str:
    t = re.sub(r"[\r,\n]\s*[\n,\t]+", "\n", (text or "").replace("\t", " "))
    return " ".join(x for x in (p.strip() for p in t.split(" ")) if x)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.last: int | None = None  # the node whose tail grows

    def _push(self, tag: str, attrs) -> None:
        parent = self.open[-1] if self.open else None
        k = len(self.nodes)
        seen = self.nodes[parent]["seen"] if parent is not None else {}
        seen[tag] = seen.get(tag, 0) + 1
        self.nodes.append({"tag": tag, "attrs": {a: v or "" for a, v in attrs}, "parent": parent, "kids": [], "seen": {}, "text": [], "tail": [], "sib": seen[tag]})
        if parent is not None:
            self.nodes[parent]["kids"].append(k)
        self.last = None
        if tag in VOID:
            self.last = k
        else:
            self.open.append(k)

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.last = self.open.pop()

    def handle_starttag(self, tag, attrs):
        if not self.nodes and tag != "html":
            self._push("html", ())
        if tag == "html" and self.nodes:
            return
        if tag in _BLOCK:
            self._implied({"p"}, {"button", "table", "td", "th"})
        if tag in _CLOSES:
            self._implied(_CLOSES[tag], _SCOPE[tag])
        self._push(tag, attrs)

    def _implied(self, tags: set[str], scope: set[str]) -> None:
        for d in range(len(self.open) - 1, 0, -1):
            t = self.nodes[self.open[d]]["tag"]
            if t in tags:
                self._close_to(d)
                return
            if t in scope:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.nodes[self.open[-1]]["tag"] == tag:
            self._close_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        for d in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[d]]["tag"] == tag:
                self._close_to(max(d, 1) if tag != "html" else d + 1)
                return

    def handle_data(self, data):
        if self.last is not None and self.open and self.nodes[self.last]["parent"] == self.open[-1]:
            self.nodes[self.last]["tail"].append(data)
        elif self.open:
            self.nodes[self.open[-1]]["text"].append(data)


def parse(html: str | None) -> list[dict]:
    """Nodes in pre-order, leaves without text and attributes left out (their number is used up). Never fails: what is open at the end is closed."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    nodes, out = b.nodes, []
    last = list(range(len(nodes)))
    for k in range(len(nodes) - 1, 0, -1):
        p = nodes[k]["parent"]
        if p is not None:
            last[p] = max(last[p], last[k])
    full = [""] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        x = nodes[k]
        x["text"], x["tail"] = "".join(x["text"]), "".join(x["tail"])
        full[k] = x["text"] + "".join(full[c] + nodes[c]["tail"] for c in x["kids"])
    depth = [0] * len(nodes)
    for k, x in enumerate(nodes):
        depth[k] = 1 if x["parent"] is None else depth[x["parent"]] + 1
        if k and not x["kids"] and not norm(x["text"]) and not norm(x["tail"]) and x["tag"] not in ("a", "img", "meta"):
            continue
        content = norm(full[k])
        out.append({"node_id": k + 1, "parent_id": None if x["parent"] is None else x["parent"] + 1, "last_id": last[k] + 1, "depth": depth[k], "sib_idx": x["sib"], "tag": x["tag"], "attrs": x["attrs"], "text": norm(x["text"]), "tail": norm(x["tail"]), "content_length": len(content), "content": content if x["tag"] in TEXTS else None})
    return out


def kids(tree: list[dict]) -> list[list[int]]:
    """Places of each node's children."""
    place, out = {n["node_id"]: k for k, n in enumerate(tree)}, [[] for _ in tree]
    for k, n in enumerate(tree):
        if n["parent_id"] in place:
            out[place[n["parent_id"]]].append(k)
    return out


def ends(tree: list[dict]) -> list[int]:
    """Behind each node, the place of the first one that is not in its subtree."""
    ids = [n["node_id"] for n in tree]
    return [bisect_right(ids, n["last_id"]) for n in tree]


def body_of(tree: list[dict]) -> list[dict]:
    """The first body's nodes, or the whole tree."""
    at = next((k for k, n in enumerate(tree) if n["tag"] == "body"), 0)
    return tree[at : ends(tree)[at]] if tree else tree


def title_node(tree: list[dict]) -> tuple[dict, int] | None:
    """As title_nodes, of one tree: the node and what it shares."""
    title = next((n["content"] for n in tree if n["tag"] == "title"), "")
    if len(title) < 2:
        return None
    b = body_of(tree)
    few, want, best = kids(b), plain_title_words(title), None
    for k, n in enumerate(b):
        if n["tag"] in ("h1", "h2", "h3", "h4", "strong") and n["content"] and len(few[k]) <= 1:
            shared = common(plain_title_words(n["content"]), want, True)
            if shared >= 1 and (best is None or shared > best[1]):
                best = n, shared
    return best


def without(tree: list[dict], gone: Callable[[dict], bool]) -> list[dict]:
    """A tree without the subtrees of such nodes; their tails go with them."""
    out, upto = [], 0
    for n in tree:
        if n["node_id"] > upto:
            if gone(n):
                upto = n["last_id"]
            else:
                out.append(n)
    return out


def changed(tree: list[dict], which: Callable[[dict], bool], **values) -> list[dict]:
    """A tree in which such nodes have other values (tag, text, tail), or attributes if attrs is given (None removes one)."""
    attrs = values.pop("attrs", {})
    new = lambda n: {**n, **values, "attrs": {k: v for k, v in {**n["attrs"], **attrs}.items() if v is not None}}
    return [new(n) if which(n) else n for n in tree]


def unwrapped(tree: list[dict], which: Callable[[dict], bool]) -> list[dict]:
    """A tree in which the children of such nodes are their parent's; the root stays."""
    up: dict[int, int | None] = {}
    out = []
    for n in tree:
        parent = n["parent_id"]
        while parent in up:
            parent = up[parent]
        if n["parent_id"] is not None and which(n):
            up[n["node_id"]] = parent
            continue
        out.append({**n, "parent_id": parent, "depth": 1 if parent is None else next(x["depth"] for x in reversed(out) if x["node_id"] == parent) + 1})
    return out
