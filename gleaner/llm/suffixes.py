"""Removal of repeated byte strings: per-shard suffix arrays, common prefixes, merging across shards."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, mixed, only, pack, parts_for, sliding_min, spread, stored, text_bytes, unpack
from .substrings import CELLS, HOT, LAST, SECOND, string_key
from .substrings import _cell as cell_of

#: Bytes of a string that counts; of the gram that anchors it; of texts in a block, packed strings in a shard, anchors in a bucket; partitions at most.
LENGTH, GRAM, TEXTS, SHARD, ANCHORS, PARTS = 100, 32, 1 << 20, 4 << 20, 8 << 20, 100_000


def byte_words(data: np.ndarray) -> np.ndarray:
    """Of each place, the next 8 bytes as a number that orders as they do; zeros fill up the end."""
    n = len(data)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key |= wide[j : j + n] << np.uint64(56 - 8 * j)
    return key


def suffix_order(key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (of bytes with these byte_words) by their first `depth` bytes (short ones filled up with zeros), and each suffix's rank: equal
    ranks are equal prefixes.

    Larsson-Sadakane: ranks by 8 bytes at first; then each round sorts what still shares a rank by the rank that
    stands as far behind as ranks reach, which doubles their reach. Settled suffixes are left alone."""
    n = len(key)
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.ones(n, bool)
    sorted_key = key[order]
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    del sorted_key
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    reach = 8
    open_ = np.flatnonzero(~new | ~np.append(new[1:], True))
    while reach < depth and len(open_):
        step = min(reach, depth - reach)
        at, group = order[open_], first[open_]
        key = group * (n + 1) + rank[np.minimum(at + step, n)] + 1
        turn = np.argsort(key)
        key, at, group = key[turn], at[turn], group[turn]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        first[open_] = np.maximum.accumulate(np.where(new, open_, 0))
        rank[at] = first[open_]
        open_ = open_[~new | ~np.append(new[1:], True)]
        reach += step
    return order, rank[:n]


_STEPS = np.array([1 << k for k in range(8, 64, 8)], np.uint64)


def common_prefixes(words: np.ndarray, order: np.ndarray, rank: np.ndarray, depth: int, lanes: int = 8_192) -> np.ndarray:
    """For each place in the order, bytes (depth at most) that its suffix shares with the one before.

    Kasai's way: along the text, a suffix shares with its predecessor at least one byte less than the suffix before
    it did. That holds where the order is the suffixes' own: behind a suffix that shares all of the depth, with which
    ranks are equal, the count starts anew. The text is cut into lanes that take their steps together, 8 bytes at once."""
    n = len(words)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    pad = np.concatenate([words, np.zeros(depth + 8, np.uint64)])
    out = np.zeros(n, np.int32)
    width = -(-n // lanes)
    lane = np.arange(0, n, width)
    have = np.zeros(len(lane), np.int64)
    for k in range(width):
        i = lane + k
        if i[-1] >= n:
            lane, have, i = lane[:-1], have[:-1], i[:-1]
        j = before[i]
        equal = (j >= 0) & (rank[i] == rank[j])
        have = np.where(equal, depth, np.where((j >= 0) & (have < depth), np.maximum(have - 1, 0), 0))
        live = np.flatnonzero((j >= 0) & ~equal)
        while len(live):
            x = pad[i[live] + have[live]] ^ pad[j[live] + have[live]]
            have[live] += 8 - np.searchsorted(_STEPS, x, side="right") - (x > 0)
            live = live[(x == 0) & (have[live] < depth)]
        have = np.minimum(have, np.minimum(depth, n - np.maximum(i, j)))
        out[i] = have
    return out[order]


class Shard:
    """Packed strings with the place (document, start) that each has first; groups of their equal windows."""

    def __init__(self, strings: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.length = length
        sizes = np.array([len(s) for s in strings], np.int64)
        self.first_byte = np.cumsum(sizes) - sizes
        self.windows = sizes - length + 1
        owner, number = spread(self.windows)
        words = byte_words(self.data)
        order, rank = suffix_order(words, length)
        whole = np.zeros(len(self.data), bool)
        self.at = self.first_byte[owner] + number
        whole[self.at] = True
        shared = common_prefixes(words, order, rank, length)
        # Only whole windows stand in the groups; what lies between two of them shares no less.
        low = np.flatnonzero(shared < length)
        group_of = np.zeros(len(order), np.int64)
        group_of[low] = 1
        group_of = np.cumsum(group_of)
        keep = whole[order]
        self.order, group_of = order[keep], group_of[keep]
        self.new = np.ones(len(self.order), bool)
        self.new[1:] = group_of[1:] != group_of[:-1]
        index = np.empty(len(self.data), np.int64)
        index[self.at] = np.arange(len(self.at))
        self.window = index[self.order]  # number of the window, in the order of suffixes
        self.doc, self.base, self.number = docs[owner], starts[owner], number
        self.best()

    def best(self) -> None:
        """Each group's first place: (document, start)."""
        w = self.window
        heads = np.flatnonzero(self.new)
        group = np.cumsum(self.new) - 1
        self.low_doc, self.low_at = self.doc[w[heads]], (self.base[w] + self.number[w])[heads]
        more = np.flatnonzero(~self.new | ~np.append(self.new[1:], True))
        if len(more):
            w, group = w[more], group[more]
            turn = np.lexsort((self.base[w] + self.number[w], self.doc[w], group))
            w, group = w[turn], group[turn]
            lead = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            self.low_doc[group[lead]], self.low_at[group[lead]] = self.doc[w[lead]], (self.base[w] + self.number[w])[lead]

    def sample(self, groups: np.ndarray) -> np.ndarray:
        at = self.order[np.flatnonzero(self.new)[groups]]
        return self.data[at[:, None] + np.arange(self.length)]

    def find(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By binary search over the order of suffixes: the group that each row of bytes falls on, and whether it is equal."""
        heads = self.order[self.new]
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(heads))
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(heads) - 1)
            less = _below(self.data[heads[mid][:, None] + np.arange(self.length)], rows)
            go = lo < hi
            lo, hi = np.where(go & less, mid + 1, lo), np.where(go & ~less, mid, hi)
        at = np.minimum(lo, len(heads) - 1)
        return at, (self.data[heads[at][:, None] + np.arange(self.length)] == rows).all(1)

    def merge(self, other: Shard, block: int = 1 << 15) -> None:
        """Both shards learn the first places of strings that both hold."""
        for lo in range(0, len(self.low_doc), block):
            mine = np.arange(lo, min(lo + block, len(self.low_doc)))
            theirs, equal = other.find(self.sample(mine))
            mine, theirs = mine[equal], theirs[equal]
            d1, a1, d2, a2 = self.low_doc[mine], self.low_at[mine], other.low_doc[theirs], other.low_at[theirs]
            ours = (d1 < d2) | ((d1 == d2) & (a1 <= a2))
            self.low_doc[mine] = other.low_doc[theirs] = np.where(ours, d1, d2)
            self.low_at[mine] = other.low_at[theirs] = np.where(ours, a1, a2)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window, in the order of strings, its first place, as document and start less the window's number."""
        group = np.cumsum(self.new) - 1
        doc, base = np.empty(len(self.window), np.int64), np.empty(len(self.window), np.int64)
        doc[self.window] = self.low_doc[group]
        base[self.window] = self.low_at[group] - self.number[self.window]
        return doc, base


def _below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    at = differ.argmax(1)
    k = np.arange(len(a))
    return differ.any(1) & (a[k, at] < b[k, at])


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, blob): documents of a task, packed by TEXTS bytes."""

    def run(batches):
        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= TEXTS or len(ids) == 65_536:
                    yield pa.RecordBatch.from_arrays([pa.array([_packed(ids, texts)], pa.binary())], ["blob"])
                    ids, texts, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(ids, texts)], pa.binary())], ["blob"])

    return docs.mapInArrow(run, "blob binary").select(F.monotonically_increasing_id().alias("block"), "blob")


def _packed(ids: list, texts: list[bytes]) -> bytes:
    known = np.array([i is not None for i in ids])
    return pack(np.array([LAST if i is None else i for i in ids], np.int64), known, np.array([len(t) for t in texts], np.int64), b"".join(texts), level=5)


def _opened(blob: bytes):
    ids, known, sizes, raw = unpack(blob)
    return np.frombuffer(ids, np.int64), np.frombuffer(known, bool), np.frombuffer(sizes, np.int64), raw


class Anchored:
    """A block's windows by anchor, the least gram within each. Windows of hot anchors (those in the hot cells) are dealt
    out by a second anchor, the least gram in another order: key is what deals a run of windows, value its anchor."""

    def __init__(self, blob: bytes, length: int, gram: int, cells: int = 0, hot: np.ndarray | None = None):
        self.ids, self.known, self.sizes, self.raw = _opened(blob)
        self.length = length
        data = np.frombuffer(self.raw, np.uint8)
        n = len(data)
        self.run = self.n = np.zeros(0, np.int64)
        self.value = self.key = np.zeros(0, np.uint64)
        self.span, self.grams = length - min(gram, length), np.zeros(0, np.uint64)
        if n < length:
            return
        gram = min(gram, length)
        g = gram_hashes(data, gram) | np.uint64(1)
        least = sliding_min(g, length - gram + 1)
        self.owner, self.number = spread(self.sizes)
        whole = self.number[: len(least)] + length <= self.sizes[self.owner[: len(least)]]
        self.grams, self.least = g, np.where(whole, least, 0).astype(np.uint64)
        key = least
        if hot is not None and len(hot):
            some = np.isin(cell_of(least, cells), hot)
            if some.any():
                key = np.where(some, sliding_min(mixed(g ^ SECOND), length - gram + 1), least)
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (key[1:] != key[:-1])
        self.run = np.flatnonzero(new)
        self.n = np.flatnonzero(whole & ~np.append(whole[1:] & ~new[1:], False)) - self.run + 1
        self.value, self.key = least[self.run], key[self.run]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, and which stand in more than one place: a gram anchors if it is the least of some whole
        window that holds it."""
        none = np.zeros(self.span, np.uint64)
        most = ~sliding_min(~np.concatenate([none, self.least, none]), self.span + 1) if len(self.grams) else self.grams
        values, count = np.unique(self.grams[self.grams == most[: len(self.grams)]], return_counts=True)
        return values, count > 1

    def strings(self, values: np.ndarray):
        """(anchor as a signed number, document's number, start, string) of the runs whose anchor is one of values."""
        k = np.flatnonzero(np.isin(self.value, values))
        a = self.run[k]
        for value, doc, start, lo, hi in zip(self.value[k].view(np.int64).tolist(), self.owner[a].tolist(), self.number[a].tolist(), a.tolist(), (a + self.n[k] + self.length - 1).tolist()):
            yield value, doc, start, self.raw[lo:hi]


def _repeated_anchors(blocks: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """(block, n, values): a block's anchors that stand in more than one place."""

    def deal(batches):
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1)):
                anchors, twice = Anchored(blob.as_py(), length, gram).anchors()
                to = (mixed(anchors) % np.uint64(buckets)).astype(np.int32)
                turn = np.argsort(to, kind="stable")
                some, cut = np.unique(to[turn], return_index=True)
                blobs = [pack(anchors[turn[a:z]], twice[turn[a:z]]) for a, z in zip(cut, [*cut[1:], len(turn)])]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([block] * len(some), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block", "blob"])

    def gather(batches):
        now, held = None, []

        def out():
            values = np.concatenate([v for _, v, _ in held])
            twice = np.concatenate([t for _, _, t in held])
            turn = np.argsort(values, kind="stable")
            v = values[turn]
            same = np.concatenate([[False], v[1:] == v[:-1]])
            twice[turn[same | np.append(same[1:], False)]] = True
            at = 0
            rows = []
            for block, own, _ in held:
                mine = own[twice[at : at + len(own)]]
                at += len(own)
                if len(mine):
                    rows.append((block, len(mine), mine.tobytes()))
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[lo : lo + 256]), (pa.int64(), pa.int64(), pa.binary()))], ["block", "n", "vals"])

        for b in batches:
            for bucket, block, blob in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now and held:
                    yield from out()
                    held = []
                now = bucket
                v, t = unpack(blob)
                held.append((block, np.frombuffer(v, np.uint64), np.frombuffer(t, bool)))
        if held:
            yield from out()

    dealt = blocks.mapInArrow(deal, "bucket int, block long, blob binary")
    return dealt.repartition(min(PARTS, buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "block long, n long, vals binary")


def hot_cells(repeated: DataFrame, cells: int, least: int) -> np.ndarray:
    """Of the cells that anchors are dealt to, those that more than HOT times their share of the repeated ones (and `least` of
    them) fall on; an anchor counts once for each block. Fewer than cells / HOT."""

    def run(batches):
        total = np.zeros(cells, np.int64)
        for b in batches:
            for v in b.column(0).to_pylist():
                np.add.at(total, cell_of(np.frombuffer(v, np.uint64), cells), 1)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["cell", "n"])

    per = stored(repeated.select("vals").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    total = per.agg(F.sum("n")).first()[0] or 0
    return np.sort(per.where(F.col("n") > max(HOT * total // cells, least)).select("cell").toArrow().column(0).to_numpy())


def _first_places(blocks: DataFrame, repeated: DataFrame, buckets: int, length: int, gram: int, shard: int, cells: int, hot: np.ndarray) -> DataFrame:
    """(block, blob): for strings of the block with a window that stands earlier elsewhere, the first places of all windows."""

    def deal(batches):
        for b in batches:
            for block, blob, lists in zip(*(c.to_pylist() for c in b.columns)):
                x = Anchored(blob, length, gram, cells, hot)
                seen: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
                values = np.concatenate([np.frombuffer(v, np.uint64) for v in lists])
                runs = np.isin(x.value, values)
                to = iter((mixed(x.key[runs]) % np.uint64(buckets)).tolist())
                for value, doc, start, s in x.strings(values):
                    place = (int(x.ids[doc]), start)
                    own = seen[next(to)]
                    y = own.get(s)
                    if y is None:
                        own[s] = [*place, *place, value]
                    elif place < (y[0], y[1]):
                        y[0], y[1] = place
                    elif place > (y[2], y[3]):
                        y[2], y[3] = place
                some = sorted(seen)
                blobs = [pack(np.array([len(s) for s in seen[k]], np.int64), np.array(list(seen[k].values()), np.int64), b"".join(seen[k]), level=3) for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block", "blob"])

    def solve(strings: dict[bytes, list]):
        shards, keys, some, size = [], list(strings), [], 0
        for lo in keys:
            some.append(lo)
            size += len(lo)
            if size >= shard:
                shards.append(some)
                some, size = [], 0
        if some:
            shards.append(some)
        built = [Shard(x, np.array([strings[s][0] for s in x], np.int64), np.array([strings[s][1] for s in x], np.int64), length) for x in shards]
        # Forth and back, so that the first place of a string reaches each shard that holds it.
        for k in range(1, len(built)):
            for j in range(k):
                built[k].merge(built[j])
        for k in range(len(built) - 1):
            for j in range(k + 1, len(built)):
                built[k].merge(built[j])
        # Windows of all shards in a row, in the order of their strings.
        doc, base = (np.concatenate(v) for v in zip(*(x.runs() for x in built)))
        windows = np.concatenate([x.windows for x in built])
        owner, number = spread(windows)
        last_doc, last_at = np.array([strings[s][2:4] for s in keys], np.int64).T
        later = (doc < last_doc[owner]) | ((doc == last_doc[owner]) & (base < last_at[owner]))
        wanted = np.flatnonzero(np.bincount(owner[later], minlength=len(keys)))
        cut = np.flatnonzero(np.append((doc[1:] != doc[:-1]) | (base[1:] != base[:-1]) | (owner[1:] != owner[:-1]), True))
        told = np.column_stack([number[cut] + 1, doc[cut], base[cut]])
        count = np.bincount(owner[cut], minlength=len(keys))
        first = np.cumsum(count) - count
        replies: dict[int, list[int]] = {}
        names = {}
        for k in wanted.tolist():
            s = keys[k]
            names[k] = (*string_key(s), strings[s][5])
            for block in strings[s][4]:
                replies.setdefault(block, []).append(k)
        for block, some in replies.items():
            k = np.array(some)
            which, nth = spread(count[k])
            yield block, pack(np.array([names[i] for i in some], np.int64), count[k], told[first[k][which] + nth])

    def gather(batches):
        now, strings = None, {}

        def out():
            rows = list(solve(strings))
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[lo : lo + 256]), (pa.int64(), pa.binary()))], ["block", "blob"])

        for b in batches:
            for bucket, block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if bucket != now and strings:
                    yield from out()
                    strings.clear()
                now = bucket
                sizes, places, raw = unpack(blob.as_py())
                at = 0
                for n, (d, a, d2, a2, value) in zip(np.frombuffer(sizes, np.int64).tolist(), np.frombuffer(places, np.int64).reshape(-1, 5).tolist()):
                    s = raw[at : at + n]
                    at += n
                    x = strings.get(s)
                    if x is None:
                        strings[s] = [d, a, d2, a2, [block], value]
                    else:
                        if (d, a) < (x[0], x[1]):
                            x[0], x[1] = d, a
                        if (d2, a2) > (x[2], x[3]):
                            x[2], x[3] = d2, a2
                        x[4].append(block)
        if strings:
            yield from out()

    lists = repeated.groupBy("block").agg(F.collect_list("vals").alias("lists"))
    dealt = blocks.join(lists, "block").select("block", "blob", "lists").mapInArrow(deal, "bucket int, block long, blob binary")
    # Partitions are sorted by bucket (on disk where need be), and one bucket is held at a time.
    return dealt.repartition(min(PARTS, max(1, buckets // 2)), "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "block long, blob binary")


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id: str = "doc_id", text: str = "text", keep_text: bool = False, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, text binary]) for each row: UTF-8 bytes without those that a
    string of `length` bytes covers which also starts earlier, in a document with a smaller id or before in its own.

    Null and empty texts have no bytes; an empty table gives an empty result; a very long text is a block of its own, held
    whole by one task; null ids come last; rows with one id are one document to each other: equal
    places are not earlier. Strings are judged on the input, never across documents.

    Windows with one anchor (their least gram) can only equal each other. Anchors that stand in one place alone are
    settled by a count; the windows of all others go to their anchor's bucket as packed strings, once for each block of
    documents; those of an anchor that holds many times its share go by a second anchor. A bucket is sorted in shards of bounded size, each by its own suffix array; groups of equal windows
    follow from common prefixes, and shards of one bucket are merged by binary search. Blocks get back the first
    places of their strings' windows."""
    d = only(docs, doc_id=id, t=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("t").cast("binary").alias("t"))
    blocks = stored(_blocks(d), "blocks")
    total = text_bytes(d, "t")
    repeated = stored(_repeated_anchors(blocks, parts_for(total * 16 // (length - gram + 2), ANCHORS, most=1 << 30), length, gram), "anchors")
    some = repeated.agg(F.sum("n")).first()[0] or 0
    buckets = parts_for(some * 2 * length, shard, most=1 << 30)
    cells = min(buckets, CELLS)
    hot = hot_cells(repeated, cells, 2 * shard // (2 * length))
    places = stored(_first_places(blocks, repeated, buckets, length, gram, shard, cells, hot), "places")
    replies = places.groupBy("block").agg(F.collect_list("blob").alias("replies"))
    met = blocks.join(replies, "block", "left").select("blob", "replies")

    def run(batches):
        for b in batches:
            for blob, replies in zip(b.column(0), b.column(1).to_pylist()):
                yield from _kept(blob.as_py(), replies or [], length, gram, keep_text, cells, hot)

    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text binary" * keep_text)


def _kept(blob: bytes, replies: list[bytes], length: int, gram: int, keep_text: bool, cells: int, hot: np.ndarray):
    ids, known, sizes, raw = _opened(blob)
    gone: list[list[tuple[int, int]]] = [[] for _ in ids]
    if replies:
        told, values = {}, []
        for r in replies:
            keys, n, runs = unpack(r)
            runs, at = np.frombuffer(runs, np.int64).reshape(-1, 3).tolist(), 0
            for key, m in zip(map(tuple, np.frombuffer(keys, np.int64).reshape(-1, 3).tolist()), np.frombuffer(n, np.int64).tolist()):
                told[key[:2]] = runs[at : at + m]
                values.append(key[2])
                at += m
        x = Anchored(blob, length, gram, cells, hot)
        for _, doc, start, s in x.strings(np.array(values, np.int64).view(np.uint64)):
            i, at = int(ids[doc]), 0
            for end, low, base in told.get(string_key(s), ()):
                if low < i or low == i and base < start:
                    gone[doc].append((start + at, start + end + length - 1))
                at = end
    cuts = np.cumsum(sizes) - sizes
    rows = []
    for k in range(len(ids)):
        data = raw[int(cuts[k]) : int(cuts[k] + sizes[k])]
        kept, at, spans = [], 0, 0
        for a, b in sorted(gone[k]):
            if a > at or not spans:
                kept.append(data[at:a])
                spans += 1
            at = max(at, b)
        kept.append(data[at:])
        line = b"".join(kept)
        rows.append((int(ids[k]) if known[k] else None, len(data), len(data) - len(line), spans, hashlib.sha256(line).hexdigest(), line))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 + keep_text]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    for lo in range(0, len(rows), 4_096):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows[lo : lo + 4_096]))[: len(types)], types)], names[: len(types)])
