"""SimHash near-duplicate groups over a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, parts_for, stored, without
from .graph import components, local_roots

#: Fingerprints that one partition of the index takes, and from which a block counts as hot.
INDEX_ROWS = 50_000


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of the word shingles; words are parted by ASCII space, A-Z count as a-z.
    Fewer words than a shingle: the whole sequence. No words: 0."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
    h = np.fromiter([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


class GrayIndex:
    """Distinct fingerprints in the order of their Gray rank. Runs of `fan` neighbours share an upper node that
    holds the bits they have in common; a node keeps only the bits its parent lacks. A search adds up differences
    from the top and drops a node with all that hangs below it once they exceed the radius."""

    def __init__(self, values: np.ndarray, fan: int = 8):
        rank = values.astype(np.uint64, copy=True)
        for s in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(s)
        self.order = np.argsort(rank, kind="stable")
        self.fan = fan
        value = values.astype(np.uint64)[self.order]
        mask = np.full(len(value), ~np.uint64(0))
        self.levels = []  # from the leaves up: value, bits of its own
        while True:
            if len(value) <= fan:
                self.levels.append((value, mask))
                break
            first = np.arange(0, len(value), fan)
            up_mask = np.bitwise_and.reduceat(mask, first)
            differ = np.bitwise_or.reduceat(value ^ np.repeat(value[first], fan)[: len(value)], first)
            up_mask &= ~differ
            self.levels.append((value, mask & ~np.repeat(up_mask, fan)[: len(value)]))
            value, mask = value[first] & up_mask, up_mask

    def search(self, queries: np.ndarray, radius: int = 3, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query's index, value's index) of all pairs at the radius or less, for blocks of queries."""
        top, _ = self.levels[-1]
        for lo in range(0, len(queries), block):
            some = queries[lo : lo + block].astype(np.uint64)
            q = np.repeat(np.arange(len(some)), len(top))
            node = np.tile(np.arange(len(top)), len(some))
            gone = np.zeros(len(q), np.uint8)
            for depth in range(len(self.levels) - 1, -1, -1):
                value, own = self.levels[depth]
                gone = gone + np.bitwise_count((some[q] ^ value[node]) & own[node])
                keep = gone <= radius
                q, node, gone = q[keep], node[keep], gone[keep]
                if depth:
                    below = len(self.levels[depth - 1][0])
                    q, gone = np.repeat(q, self.fan), np.repeat(gone, self.fan)
                    node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    if len(node) and node.max() >= below:
                        keep = node < below
                        q, node, gone = q[keep], node[keep], gone[keep]
            yield q + lo, self.order[node]


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): fp holds the 64 bits as a signed number."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    narrow = only(docs, doc_id=id, text=text).select("doc_id", F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp long")


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fps (fp long, distinct) -> (a, b): a spanning forest, by partition, of the links at the radius or less.

    radius + 1 blocks of bits: two linked fingerprints agree on one at least, so each fingerprint travels once for
    each block and meets its partners in the partition of that block's value. A block value with more than
    INDEX_ROWS fingerprints is dealt out again, by the same argument, over blocks of its other bits. Only a
    forest leaves a partition, so a large group of near copies costs one edge for each member."""
    n = radius + 1
    width = 64 // n
    keys = fps.select("fp", F.posexplode(F.array(*(F.shiftrightunsigned("fp", 64 - width * (t + 1)).bitwiseAND((1 << width) - 1) for t in range(n)))).alias("t", "block"))
    hot = stored(keys.groupBy("t", "block").count().where(F.col("count") > INDEX_ROWS).select("t", "block", F.lit(True).alias("hot")), "hot")
    span = (64 - width) // n
    turned = f"if(t = 0, fp, shiftleft(fp, t * {width}) | shiftrightunsigned(fp, 64 - t * {width}))"
    runs = ", ".join(f"struct({u} as u, shiftrightunsigned({turned}, {64 - width - span * (u + 1)}) & {(1 << span) - 1} as sub)" for u in range(n))
    if hot.isEmpty():
        dealt = keys.select("fp", "t", "block", F.lit(-1).alias("u"), F.lit(0).cast("long").alias("sub"))
    else:
        runs = F.expr(f"explode(if(hot, array({runs}), array(struct(-1 as u, 0L as sub))))")
        dealt = keys.join(hot, ["t", "block"], "left").select("fp", "t", "block", runs.alias("r")).select("fp", "t", "block", "r.u", "r.sub")
    parts = parts_for(fps.count() * n, INDEX_ROWS)

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        fp, t = table.column("fp").to_numpy().astype(np.int64), table.column("t").to_numpy()
        for k in np.unique(t):
            own = np.unique(fp[t == k]).view(np.uint64)
            turned = own if k == 0 else (own << np.uint64(width * k)) | (own >> np.uint64(64 - width * k))
            root = np.arange(len(own))
            index = GrayIndex(turned)
            for a, b in index.search(turned, radius):
                far = a != b
                root = local_roots(len(own), np.concatenate([np.arange(len(own)), a[far]]), np.concatenate([root, b[far]]))
            linked = np.flatnonzero(root != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(own[linked].view(np.int64)), pa.array(own[root[linked]].view(np.int64))], ["a", "b"])

    return dealt.repartition(parts, "t", "block", "u", "sub").select("fp", "t").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): near-duplicate groups of documents.

    Null and empty texts have fingerprint zero and link like any other; repeated rows stay repeated; ids may be
    null (they never become a component's id unless it has no other); an empty table gives an empty result.
    component_id is the smallest doc_id reachable over links of radius or fewer differing bits."""
    all_fps = stored(fingerprints(docs, id, text, shingle), "fps")
    distinct = stored(all_fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = stored(rooted.join(least, "root").select("fp", "component_id"), "byfp")
    return all_fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but the smallest doc_id of each group; rows that repeat that id all stay, and so do rows without one."""
    g = groups(docs, id, text)
    gone = g.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone").select("doc_id")
    return without(docs, id, gone)
