"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, pack, span_hashes, stored, text_bytes, unpack, word_bounds

#: Words of a seed and of the shortest tile, share of an item's words that tiles must cover, bytes of benchmark text that is broadcast, bytes of document text scanned at once, and the power of 2 of a bitmap's bits at most.
SEED, COVERAGE, BLOCK, SCAN, BITS = 5, 0.5, 8 << 20, 1 << 20, 30
_KEPT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BITS = 22


_MARKS = re.compile(r"[^\w\s]|_|\s")
#: Scripts that are written without spaces, of which each character is a word (kana, CJK ideographs, Thai to Tibetan, Hangul has spaces).
_ALONE = re.compile("([\u0e00-\u0fff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def text_line(text: bytes | None) -> bytes:
    """The text's words, parted by one space: lower-case runs of letters and digits of any script; punctuation, symbols
    and spaces of any script part words, and each character of a script without spaces is a word."""
    raw = text or b""
    if raw.isascii():
        return b" ".join(raw.lower().translate(_KEPT).split())
    t = raw.decode("utf-8", "replace").lower()
    if _ALONE.search(t):
        t = _ALONE.sub(r" \1 ", t)
    return b" ".join(_MARKS.sub(" ", t).encode().split())


def words_line(text: bytes | None) -> bytes:
    """The text's words, lower-case runs of letters and digits (of ASCII; other characters count as letters), parted by one space."""
    return b" ".join((text or b"").decode("utf-8", "replace").lower().encode().translate(_KEPT).split())


def hashed(line: bytes) -> np.ndarray:
    if not line:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(line, np.uint8)
    return span_hashes(data, *word_bounds(data))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(h) - n + 1)
    return span_hashes(h, at, at + n)


def tiles(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of numbers: (length, place in item, place in doc), longest first.

    Each round finds the greatest length that unmarked runs of both share, by bisection over Karp-Rabin hashes, and
    marks its matches from left to right, each unmarked place once, if the numbers themselves are equal. Rounds end
    below the least length."""
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    out: list[tuple[int, int, int]] = []

    def open_runs(h, free, n):
        if len(h) < n:
            return np.zeros(0, np.int64)
        busy = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(busy[n:] == busy[:-n])

    def shared(n):
        a, b = open_runs(item, free_i, n), open_runs(doc, free_d, n)
        if not len(a) or not len(b):
            return None
        ga, gb = grams(item, n)[a], grams(doc, n)[b]
        hit = np.isin(gb, ga)
        return (a, ga, b[hit], gb[hit]) if hit.any() else None

    high = min(len(item), len(doc))
    while high >= least:
        lo, hi, got = least, high, shared(least)
        if got is None:
            break
        while lo < hi:
            mid = (lo + hi + 1) // 2
            more = shared(mid)
            if more is None:
                hi = mid - 1
            else:
                lo, got = mid, more
        places: dict[int, list[int]] = {}
        for i, g in zip(got[0][::-1].tolist(), got[1][::-1].tolist()):
            places.setdefault(g, []).append(i)
        before = len(out)
        for d, g in zip(got[2].tolist(), got[3].tolist()):
            if not free_d[d : d + lo].all():
                continue
            mine = places[g]
            while mine and not free_i[mine[-1] : mine[-1] + lo].all():
                mine.pop()
            if mine and (item[mine[-1] : mine[-1] + lo] == doc[d : d + lo]).all():
                i = mine.pop()
                free_i[i : i + lo] = False
                free_d[d : d + lo] = False
                out.append((lo, i, d))
        high = lo if len(out) > before and shared(lo) is not None else lo - 1
    return out


class Index:
    """A block of items by their seeds."""

    def __init__(self, ids: list, lines: list[bytes]):
        self.ids, self.lines, self.items = ids, lines, [hashed(x) for x in lines]
        owner = [np.full(max(0, len(h) - SEED + 1), k, np.int64) for k, h in enumerate(self.items)]
        g = [grams(h, SEED) for h in self.items]
        self.g, self.owner = np.concatenate([np.zeros(0, np.uint64), *g]), np.concatenate([np.zeros(0, np.int64), *owner])
        # A seed that an item repeats counts once.
        order = np.lexsort((self.owner, self.g))
        self.g, self.owner = self.g[order], self.owner[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.g[1:] != self.g[:-1]) | (self.owner[1:] != self.owner[:-1])
        self.g, self.owner = self.g[new], self.owner[new]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.g & np.uint64((1 << _BITS) - 1)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the document, item) of all shared seeds."""
        g = grams(h, SEED)
        at = np.flatnonzero(self.maybe[g & np.uint64((1 << _BITS) - 1)])
        lo, hi = np.searchsorted(self.g, g[at]), np.searchsorted(self.g, g[at], side="right")
        n = hi - lo
        first = np.repeat(lo - (np.cumsum(n) - n), n)
        return np.repeat(at, n), self.owner[first + np.arange(len(first))]


def cover(item: bytes, words: list[bytes], places: np.ndarray, coverage: float) -> tuple[int, int, int] | None:
    """(covered words, tiles, the item's words) of one item and a document whose seeds at these places (rising) may be the
    item's, if that is enough. Words are compared, not hashes."""
    own = item.split(b" ")
    number = {w: k for k, w in enumerate(own, 1)}
    if len(np.unique((places[:, None] + np.arange(SEED)).ravel())) < coverage * len(own):
        return None
    # Only words within shared seeds can be tiled; a break stands where others were.
    apart = np.flatnonzero(np.diff(places) > SEED - 1) + 1
    runs = []
    for x in np.split(places, apart):
        runs += [number.get(w, 0) for w in words[x[0] : x[-1] + SEED]] + [0]
    found = tiles(np.array([number[w] for w in own], np.uint64), np.array(runs, np.uint64))
    covered = sum(n for n, _, _ in found)
    return (covered, len(found), len(own)) if found and covered >= coverage * len(own) else None


def grouped(texts: list[bytes | None]):
    """(number of the first text, words of all, starts of the texts among them, hashes of the words) by SCAN bytes."""
    at = 0
    while at < len(texts):
        lines, size, first = [], 0, at
        while at < len(texts) and size < SCAN:
            lines.append(text_line(texts[at]))
            size += len(lines[-1])
            at += 1
        # \1 is no word of an item, so no seed spans two documents.
        line = b" \x01 ".join(x or b"\x02" for x in lines)
        sizes = np.array([max(1, x.count(b" ") + bool(x)) for x in lines])
        yield first, line, np.cumsum(sizes + 1) - sizes - 1, hashed(line)


def scan(index: Index, texts: list[bytes | None], coverage: float):
    """(number of the text, item, covered words, tiles, item's words) where tiles cover enough of an item."""
    for first, line, starts, h in grouped(texts):
        place, item = index.hits(h)
        if not len(place):
            continue
        words = line.split(b" ")
        doc = np.searchsorted(starts, place, side="right") - 1
        order = np.lexsort((place, item, doc))
        doc, item, place = doc[order], item[order], place[order]
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
        for a, b in zip(cut, [*cut[1:], len(doc)]):
            if found := cover(index.lines[item[a]], words, place[a:b], coverage):
                yield first + int(doc[a]), int(item[a]), *found


def _index(items: DataFrame):
    """Items of BLOCK bytes at most, as a broadcast that a task makes its Index of."""
    rows = items.orderBy("item_id", "t").collect()
    return items.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], pack(*(text_line((r["t"] or "").encode()) for r in rows))))


def _seeds(docs: DataFrame, maybe=None) -> DataFrame:
    """docs (k, t binary) -> (seed, k) for each distinct seed of a text; with maybe, of those that may be an item's."""

    def run(batches):
        bits = maybe.value if maybe else None
        for b in batches:
            for first, _, starts, h in grouped(b.column(1).to_pylist()):
                g = grams(h, SEED)
                doc = np.searchsorted(starts, np.arange(len(g)), side="right") - 1
                if len(g):
                    whole = np.arange(len(g)) + SEED <= np.append(starts[1:] - 1, len(h))[doc]
                    if bits is not None:
                        low = g & np.uint64(len(bits) * 8 - 1)
                        whole &= (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    pair = np.unique(np.column_stack([doc[whole].astype(np.int64), g[whole].view(np.int64)]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 1].copy()), b.column(0).take(pa.array(pair[:, 0] + first))], ["seed", "k"])

    return docs.select("k", "t").mapInArrow(run, f"seed long, k {docs.schema['k'].dataType.simpleString()}")


def _bitmap(seeds: DataFrame):
    """Which seeds may be an item's: one bit for the low bits of each, 8 to 16 bits a seed and 2^BITS at most. Tasks make
    stretches of it, which the driver puts together and broadcasts."""
    n = seeds.count()
    bits = 1 << min(BITS, max(16, (8 * max(1, n)).bit_length()))
    low = F.col("seed").bitwiseAND(bits - 1)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            part, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(part).tolist():
                held.setdefault(p, np.zeros(1 << 16, bool))[at[part == p]] = True
        for p, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    parts = seeds.select(F.shiftright(low, 16).alias("part"), low.bitwiseAND((1 << 16) - 1).alias("at")).distinct().repartition("part").mapInArrow(run, "part long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"] << 13 : (r["part"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return seeds.sparkSession.sparkContext.broadcast(out)


def _joined(d: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """d (doc_id, t binary, th) -> (doc_id, th, item_id, n_tiles, covered, item_words), for items beyond one block: seeds of
    documents, as far as they may be items', meet those of items in one join; texts travel for pairs that share some."""
    kept = stored(items.select("item_id", F.col("t").cast("binary").alias("t")).withColumn("k", F.monotonically_increasing_id()), "items")
    theirs = stored(_seeds(kept.select(F.col("k"), "t")), "itemseeds")
    ours = _seeds(d.select(F.struct("doc_id", "th").alias("k"), "t"), _bitmap(theirs)).select("seed", "k.doc_id", "k.th").distinct()
    pairs = stored(ours.join(theirs, "seed").groupBy("doc_id", "th", "k").agg(F.count("*").alias("n")).drop("n"), "pairs")
    pairs = pairs.join(kept.withColumnRenamed("t", "item"), "k")
    x, y = d.alias("x"), pairs.alias("y")
    met = x.join(y, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.th") == F.col("y.th"))).select("x.doc_id", "x.th", "y.item_id", "x.t", "y.item")

    def run(batches):
        for b in batches:
            rows = []
            for k, (t, item) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist())):
                rows += [(k, n, covered, size) for _, _, covered, n, size in scan(Index([0], [text_line(item)]), [t], coverage)]
            if rows:
                k, n, covered, size = zip(*rows)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(k)) for c in range(3)), *(pa.array(x, pa.int64()) for x in (n, covered, size))], ["doc_id", "th", "item_id", "n_tiles", "covered", "item_words"])

    kind = lambda c: met.schema[c].dataType.simpleString()
    return met.mapInArrow(run, f"doc_id {kind('doc_id')}, th long, item_id {kind('item_id')}, n_tiles long, covered long, item_words long")


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_tiles, covered long, item_words long, coverage double): the pairs where tiles of SEED words
    or more cover `coverage` of an item's words, in whatever order they stand in the document.

    Documents are scanned whole, once. Items of BLOCK bytes of text in all are broadcast; more are joined by their seeds.
    Null and empty texts match nothing; neither do items of fewer than SEED words. Repeated rows of either side give
    repeated rows; ids may be null. An empty table on either side gives an empty result."""
    d = only(docs, doc_id=id, t=text).select("doc_id", F.col("t").cast("binary").alias("t"))
    items = only(benchmark, item_id=item_id, t=item_text)
    if text_bytes(items, "t") > BLOCK:
        out = _joined(d.withColumn("th", F.xxhash64("t")), items, coverage).drop("th")
        return out.withColumn("coverage", F.col("covered") / F.col("item_words"))
    held = _index(items)
    dtype, itype = (x.schema[c].dataType.simpleString() for x, c in ((d, "doc_id"), (items, "item_id")))

    def run(batches):
        ids, blob = held.value
        index = Index(ids, unpack(blob))
        for b in batches:
            found = list(scan(index, b.column(1).to_pylist(), coverage))
            if found:
                doc, item, covered, n, size = zip(*found)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array([ids[i] for i in item]), pa.array(n, pa.int64()), pa.array(covered, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "item_id", "n_tiles", "covered", "item_words"])

    out = d.mapInArrow(run, f"doc_id {dtype}, item_id {itype}, n_tiles long, covered long, item_words long")
    return out.withColumn("coverage", F.col("covered") / F.col("item_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text matches an item. It goes by rows: another row of the same id stays if its own text
    is clean, and a row without an id goes if its text isn't. Null and empty texts stay."""
    items = only(benchmark, item_id=item_id, t=item_text)
    if text_bytes(items, "t") > BLOCK:
        d = only(docs, doc_id=id, t=text).select("doc_id", F.col("t").cast("binary").alias("t")).withColumn("th", F.xxhash64("t"))
        one, two = (f"gone_{uuid.uuid4().hex}" for _ in "ab")
        gone = stored(_joined(d, items, coverage).select(F.col("doc_id").alias(one), F.col("th").alias(two)).distinct(), "gone")
        return docs.join(gone, F.col(f"`{id}`").eqNullSafe(F.col(one)) & (F.xxhash64(F.col(f"`{text}`").cast("binary")) == F.col(two)), "left_anti")
    held, at = _index(items), docs.columns.index(text)

    def run(batches):
        ids, blob = held.value
        index = Index(ids, unpack(blob))
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[k for k, *_ in scan(index, b.column(at).cast(pa.binary()).to_pylist(), coverage)]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
