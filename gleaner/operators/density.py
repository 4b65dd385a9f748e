"""Main text by text density (composite). A page's counts, densities and marks are one fold over its tree, made where the page
is parsed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tree import body_of, ends, kids
from . import dom as D

#: Tags that count as links.
LINKS = ("a", "button", "select")
_STATS = "node_id int, char_num int, tag_num int, linkchar_num int, linktag_num int, ratio double, text_density double, density_sum double, max_density_sum double, threshold double, mark int"


def counts(b: list[dict]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of a body's nodes: characters, descendants, characters and tags of links."""
    below, n = kids(b), len(b)
    char, tag, inside, lc, lt = [x["content_length"] for x in b], [0] * n, [False] * n, [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        tag[k] = sum(tag[c] + 1 for c in below[k])
    for k in range(n):
        inside[k] = inside[k] or b[k]["tag"] in LINKS
        for c in below[k]:
            inside[c] = inside[k]
    for k in range(n - 1, -1, -1):
        if inside[k]:
            lc[k], lt[k] = char[k], tag[k]
        else:
            lc[k] = sum(lc[c] for c in below[k])
            lt[k] = sum(lt[c] + int(b[c]["tag"] in LINKS or (lt[c] == tag[c] and char[c] == lc[c] and lt[c] != 0)) for c in below[k])
    return char, tag, lc, lt


def density(c: Column, t: Column, lc: Column, lt: Column, ratio: Column) -> Column:
    """a * ln(b) / ln(ln(base)): 0 without characters; all counts are 1 at least."""
    one = lambda x: F.greatest(x, F.lit(1)).cast("double")
    t, lc1, lt, u = one(t), one(lc), one(lt), one(c - lc)
    base = F.log(c * lc1 / u + ratio * c + math.e)
    return F.when(c == 0, 0.0).otherwise(c / t * F.log((c / lc1) * (t / lt)) / F.log(base))


def gap(length: Column, ratio: Column) -> Column:
    """Weight of untagged text; none where the page has no links."""
    inner = F.log(F.log(ratio * length + math.e))
    return F.when((length > 0) & (ratio > 0), F.coalesce(F.try_divide(length * F.log(length), inner), F.lit(0.0))).otherwise(0.0)


def plain_density(c: int, t: int, lc: int, lt: int, ratio: float) -> float:
    """density() of numbers."""
    if not c:
        return 0.0
    t, lc1, lt, u = max(t, 1), max(lc, 1), max(lt, 1), max(c - lc, 1)
    below = math.log(math.log(c * lc1 / u + ratio * c + math.e))
    return c / t * math.log((c / lc1) * (t / lt)) / below if below else 0.0


def plain_gap(length: int, ratio: float) -> float:
    """gap() of numbers."""
    if length <= 0 or ratio <= 0:
        return 0.0
    below = math.log(math.log(ratio * length + math.e))
    return length * math.log(length) / below if below else 0.0


def folded(tree: list[dict]) -> tuple[list[dict], list[tuple]]:
    """A tree's body and its rows of _STATS.

    A leaf's density sum is its density; others add those of their children and the gaps that their own text and their
    children's tails are. Threshold: least density from the body to the node of the greatest sum. Of every node down to
    which densities keep to it, the subtree node of the greatest sum (the first on a tie) is content (mark 1), with all
    below; what leads to one is marked 2, the rest 0."""
    b = body_of(tree)
    below, stop, n = kids(b), ends(b), len(b)
    char, tag, lc, lt = counts(b)
    ratio = lc[0] / max(char[0], 1)
    text = [plain_density(*x, ratio) for x in zip(char, tag, lc, lt)]
    sums = [text[k] if not below[k] else sum(text[c] + plain_gap(len(b[c]["tail"]), ratio) for c in below[k]) + plain_gap(len(b[k]["text"]), ratio) for k in range(n)]
    most, best, parent = sums[:], list(range(n)), [-1] * n
    nine = [round(s, 9) for s in sums]
    for k in range(n - 1, -1, -1):
        for c in below[k]:
            parent[c] = k
            most[k] = max(most[k], most[c])
            if (-nine[best[c]], best[c]) < (-nine[best[k]], best[k]):
                best[k] = best[c]
    at, threshold = best[0], text[best[0]]
    while parent[at] >= 0:
        at = parent[at]
        threshold = min(threshold, text[at])
    mark, open_ = [0] * n, [0] if text[0] >= threshold else []
    targets = set()
    while open_:
        k = open_.pop()
        targets.add(best[k])
        open_ += [c for c in below[k] if text[c] >= threshold]
    for k in targets:
        mark[k : stop[k]] = [1] * (stop[k] - k)
    for k in targets:
        while (k := parent[k]) >= 0 and not mark[k]:
            mark[k] = 2
    return b, [(b[k]["node_id"], char[k], tag[k], lc[k], lt[k], ratio, text[k], sums[k], most[k], threshold, mark[k]) for k in range(n)]


def marked(pages: DataFrame) -> DataFrame:
    """(page_id, node_id, char_num, tag_num, linkchar_num, linktag_num, ratio, text_density, density_sum, max_density_sum,
    threshold, mark) of the body nodes of pages (page_id, html)."""
    return D.trees(pages, lambda tree: folded(tree)[1], _STATS)


def main_text(tree: list[dict]) -> str:
    """Texts and tails of the marked nodes, in order; a tail stays if its parent does."""
    b, rows = folded(tree)
    alive = {r[0] for r in rows if r[-1]}
    parts = (" ".join(x for x in (n["text"], n["tail"] if n["parent_id"] in alive else "") if x) for n in b if n["node_id"] in alive)
    return " ".join(x for x in parts if x)


def article(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, keep.., para): main texts of pages (page_id, html) that have any element."""
    return D.trees(pages, lambda tree: [(main_text(tree),)], "para string", keep)
