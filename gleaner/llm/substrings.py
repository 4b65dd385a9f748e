"""Removal of repeated word windows, by super-k-mers."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, mixed, only, pack, parts_for, sliding_min, span_hashes, spread, stored, text_bytes, unpack, word_bounds

#: Words of a window and of the grams whose least is its minimiser (single words are too common to spread); bytes of packed strings in a bucket, of text cut at once and of distinct strings held by a task; buckets of a partition at least, and partitions at most.
WINDOW, GRAM, BUCKET, CUT, HELD, BUCKETS, PARTS = 50, 4, 4 << 20, 1 << 20, 48 << 20, 4, 100_000
LAST = 2**63 - 1
#: Cells that minimisers are counted in at most, the multiple of its share from which a cell is hot, and what turns a gram's place among the minimisers.
CELLS, HOT, SECOND = 1 << 20, 8, np.uint64(0x2545F4914F6CDD1D)


def super_kmers(texts: pa.Array, window: int, cells: int = 0, hot: np.ndarray | None = None, pack_strings: bool = True):
    """(number of the text, first word, windows, minimiser, packed string or its bytes) of each run of windows with one
    minimiser. Windows whose minimiser is in one of the hot cells (sorted, of `cells`) go by another one, the least of their grams
    in another order."""
    at = 0
    while at < len(texts):
        words, sizes, first, held = [], [], at, 0
        while at < len(texts) and held < CUT:
            text = texts[at].as_py() or b""
            w = text.split()
            words += w
            sizes.append(len(w))
            held += len(text)
            at += 1
        if len(words) < window:
            continue
        line = b" ".join(words)
        data = np.frombuffer(line, np.uint8)
        starts, ends = word_bounds(data)
        gram = min(GRAM, window)
        grams = gram_hashes(span_hashes(data, starts, ends), gram)
        least = sliding_min(grams, window - gram + 1)
        if hot is not None and len(hot):
            some = np.isin(_cell(least, cells), hot)
            if some.any():
                least = np.where(some, sliding_min(mixed(grams ^ SECOND), window - gram + 1), least)
        sizes = np.array(sizes)
        owner, number = spread(sizes)
        whole = number[: len(least)] + window <= sizes[owner[: len(least)]]
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
        run = np.flatnonzero(new)
        # A run ends where the next begins or windows stop being whole.
        stop = np.flatnonzero(whole & ~np.append(whole[1:] & ~new[1:], False))
        n = stop - run + 1
        cuts = zip(starts[run].tolist(), ends[run + n + window - 2].tolist())
        yield owner[run] + first, number[run], n, least[run], [line[a:b] for a, b in cuts] if pack_strings else ends[run + n + window - 2] - starts[run]


def _cell(least: np.ndarray, cells: int) -> np.ndarray:
    return (mixed(least) % np.uint64(cells)).astype(np.int64)


def hot_cells(docs: DataFrame, cells: int, window: int) -> np.ndarray:
    """Of the minimisers, dealt to `cells` cells, those cells that hold more than HOT times their share of all packed
    strings (fewer than cells / HOT), sorted. Each task sends one number for a cell at most."""

    def run(batches):
        total = np.zeros(cells, np.int64)
        for b in batches:
            for _, _, _, least, sizes in super_kmers(b.column(1), window, pack_strings=False):
                np.add.at(total, _cell(least, cells), sizes)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["cell", "n"])

    per = stored(docs.select("id", "t").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    total = per.agg(F.sum("n")).first()[0] or 0
    rows = per.where(F.col("n") > max(HOT * total // cells, HOT * BUCKET)).select("cell").toArrow()
    return np.sort(rows.column(0).to_numpy())


def _distinct(docs: DataFrame, buckets: int, window: int, cells: int = 0, hot: np.ndarray | None = None) -> DataFrame:
    """(bucket, blob): of each batch, the distinct packed strings of a bucket with their smallest and largest ids."""

    def run(batches):
        seen: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        held = 0

        def out():
            rows = []
            for n, (k, d) in enumerate(seen.items(), 1):
                rows.append((k, pack(np.array([len(s) for s in d], np.int32), np.array(list(d.values()), np.int64), b"".join(d))))
                if len(rows) == 64 or n == len(seen):
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])
                    rows = []
            seen.clear()

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for doc, _, _, least, strings in super_kmers(b.column(1), window, cells, hot):
                for i, k, s in zip(ids[doc].tolist(), (mixed(least) % np.uint64(buckets)).tolist(), strings):
                    x = seen[k].get(s)
                    if x is None:
                        seen[k][s] = [i, i]
                        held += len(s) + 200
                    elif i < x[0]:
                        x[0] = i
                    elif i > x[1]:
                        x[1] = i
                if held > HELD:
                    yield from out()
                    held = 0
        yield from out()

    return docs.select("id", "t").mapInArrow(run, "bucket int, blob binary")


def string_key(s: bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    d = xxh3_128_digest(s)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def window_groups(line: bytes, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings of so many words, joined by spaces: string of each window, order of the windows in which equal ones
    stand together, and starts of the runs of equal windows in that order.

    Windows are sorted by a hash of their words; those of one hash are then held against the first of them by their
    bytes, whole stretches at once, and parted by their bytes where one differs."""
    data = np.frombuffer(line, np.uint8)
    starts, ends = word_bounds(data)
    h = span_hashes(data, starts, ends)
    n = lengths - window + 1
    owner, number = spread(n)
    at = np.repeat(np.cumsum(lengths) - lengths, n) + number
    a = span_hashes(h, at, at + window)
    order = np.argsort(a, kind="stable")
    new = np.concatenate([[True], a[order][1:] != a[order][:-1]])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = np.flatnonzero(~new)
    if len(later):
        p, q = at[order[later]], at[order[lead[later]]]
        turn = np.argsort(p)
        p, q, place = p[turn], q[turn], later[turn]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)]))
        last = np.append(first[1:], len(p)) - 1
        cuts = zip(starts[p[first]].tolist(), ends[p[last] + window - 1].tolist(), starts[q[first]].tolist(), ends[q[last] + window - 1].tolist())
        wrong = [k for k, (a0, a1, b0, b1) in enumerate(cuts) if line[a0:a1] != line[b0:b1]]
        for head in sorted({x for k in wrong for x in lead[place[first[k] : last[k] + 1]].tolist()}):
            end = head + 1 + int(np.argmax(np.append(new[head + 1 :], True)))
            own: dict[bytes, list[int]] = defaultdict(list)
            for w in order[head:end].tolist():
                own[line[starts[at[w]] : ends[at[w] + window - 1]]].append(w)
            order[head:end] = [w for x in own.values() for w in x]
            new[head + np.cumsum([len(x) for x in own.values()])[:-1]] = True
    return owner, order, np.flatnonzero(new)


def _firsts(strings: dict[bytes, list[int]], window: int):
    """(key, key, runs) of the strings with a window that starts in more than one document: for each of its windows,
    run by run, the smallest id that has it."""
    keys = list(strings)
    ids = np.array(list(strings.values()), np.int64)
    lengths = np.array([s.count(b" ") + 1 for s in keys])
    owner, order, start = window_groups(b" ".join(keys), lengths, window)
    low = np.minimum.reduceat(ids[owner[order], 0], start)
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(low, np.diff(np.append(start, len(order))))
    later = np.zeros(len(keys), bool)
    later[owner[first < ids[owner, 1]]] = True
    ends = np.cumsum(lengths - window + 1)
    for k in np.flatnonzero(later):
        mine = first[ends[k] - (lengths[k] - window + 1) : ends[k]]
        cut = np.flatnonzero(np.append(mine[1:] != mine[:-1], True))
        yield (*string_key(keys[k]), np.column_stack([cut + 1, mine[cut]]).astype(np.int64).tobytes())


def firsts(docs: DataFrame, buckets: int, window: int, cells: int = 0, hot: np.ndarray | None = None) -> DataFrame:
    dealt = _distinct(docs, buckets, window, cells, hot)

    def run(batches):
        now, strings = None, {}
        rows = []

        def out(final=False):
            rows.extend(_firsts(strings, window) if strings else ())
            strings.clear()
            while len(rows) >= (1 if final else 10_000):
                a, b, c = zip(*rows[:10_000])
                del rows[:10_000]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["k1", "k2", "runs"])

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now:
                    yield from out()
                    now = bucket
                lengths, ids, raw = unpack(blob.as_py())
                at = 0
                for n, (lo, hi) in zip(np.frombuffer(lengths, np.int32).tolist(), np.frombuffer(ids, np.int64).reshape(-1, 2).tolist()):
                    s = raw[at : at + n]
                    at += n
                    x = strings.get(s)
                    if x is None:
                        strings[s] = [lo, hi]
                    else:
                        x[0], x[1] = min(x[0], lo), max(x[1], hi)
        yield from out(True)

    # Partitions are sorted by bucket (on disk where need be), and one bucket is held at a time.
    parts = min(PARTS, max(1, buckets // BUCKETS))
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "k1 long, k2 long, runs binary")


def _places(docs: DataFrame, window: int, cells: int = 0, hot: np.ndarray | None = None) -> DataFrame:
    def run(batches):
        for b in batches:
            for doc, first, _, _, strings in super_kmers(b.column(2), window, cells, hot):
                k = np.array([string_key(s) for s in strings], np.int64).reshape(-1, 2)
                who = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), b.column(0).take(who), b.column(1).take(who), pa.array(first.astype(np.int64))], ["k1", "k2", "id", "th", "first"])

    return docs.select("id", "th", "t").mapInArrow(run, "k1 long, k2 long, id long, th long, first long")


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (id long, th long, t binary) -> (id, th, runs array<struct<a, b>>): word ranges that later copies cover."""
    buckets = parts_for(3 * text_bytes(docs, "t"), BUCKET, BUCKETS, 1 << 30)
    cells = min(buckets, CELLS)
    hot = hot_cells(docs, cells, window)
    known = stored(firsts(docs, buckets, window, cells, hot), "firsts")
    met = _places(docs, window, cells, hot).join(known, ["k1", "k2"])

    def run(batches):
        for b in batches:
            who, lo, hi = [], [], []
            for k, (i, first, runs) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
                at = 0
                for end, low in np.frombuffer(runs, np.int64).reshape(-1, 2).tolist():
                    if low < i:
                        if who and who[-1] == k and hi[-1] >= first + at:
                            hi[-1] = first + end + window - 1
                        else:
                            who.append(k)
                            lo.append(first + at)
                            hi.append(first + end + window - 1)
                    at = end
            w = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(w), b.column(1).take(w), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["id", "th", "a", "b"])

    found = met.select("id", "th", "first", "runs").mapInArrow(run, "id long, th long, a long, b long")
    return found.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("runs"))


def _narrow(docs: DataFrame, id: str, text: str) -> DataFrame:
    d = only(docs, doc_id=id, t=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("t", F.lit("")).cast("binary").alias("t"))
    return d.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("t").alias("th"), "t")


def deduplicated(docs: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]) for each row: words, parted by ASCII space, without those that a
    window covers which also starts in a document with a smaller id. Windows are judged on the input.

    Null and empty texts have no words; null ids come last; rows that repeat an id are no earlier copies of each other;
    an empty table gives an empty result. A very long text is cut into strings as any other and is held whole by one task.

    A window's bucket is that of its minimiser (its GRAM words with the least hash); runs of windows with one minimiser travel
    as one string, once for each batch of documents, however many of them hold it, and with the smallest and largest id.
    Minimisers that hold many times their share of the strings are found by a count, and their windows dealt out by
    another minimiser.
    In its bucket the windows of all strings are sorted, and each gets the smallest id that has it. Only strings with
    a repeated window go back to the documents, by an equi-join on 128-bit keys that Spark splits when skewed."""
    d = _narrow(docs, id, text)
    runs = stored(repeated(d, window), "runs").withColumnsRenamed({"id": "rid", "th": "rth"})
    met = d.join(runs, (d.id == runs.rid) & (d.th == runs.rth), "left").select("doc_id", "t", "runs")

    def run(batches):
        for b in batches:
            total, gone, sha, kept_texts = [], [], [], []
            for t, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = t.split()
                kept, at = [], 0
                for r in runs or ():
                    kept += words[at : r["a"]] if r["a"] > at else []
                    at = max(at, r["b"])
                kept += words[at:]
                total.append(len(words))
                gone.append(len(words) - len(kept))
                line = b" ".join(kept)
                sha.append(hashlib.sha256(line).hexdigest())
                kept_texts.append(line)
            cols = [b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols.append(pa.array(kept_texts, pa.binary()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(cols, names)

    out = met.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text binary" * keep_text)
    return out.withColumn("text", F.col("text").cast("string")) if keep_text else out
