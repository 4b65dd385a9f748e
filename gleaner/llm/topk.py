"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, pack, parts_for, stored, unpack

#: Vectors of a bucket and of a block of queries, and the local threshold from which coordinates prune.
BUCKET, QUERIES, COORDINATES_FROM, FOCUS = 4_096, 1_024, 0.7, 4
#: Query blocks and buckets of a group at most, bytes of a group of queries, and cells that are enough to keep a cluster busy.
GRID, MEMORY, CELLS = (32, 64), 64 << 20, 4_096


def quantised(vectors: DataFrame, id: str, vector: str, scale: float = 256.0) -> DataFrame:
    """(vec_id, norm double, q binary): floor(scale * x) of each component, as 64-bit numbers. Vectors that are null
    or hold a null or non-finite component are left out; components beyond 64 bits are held at their limit."""

    def run(batches):
        for b in batches:
            keep, norms, packed = [], [], []
            for k, x in enumerate(b.column(1).to_pylist()):
                if x is None or any(v is None for v in x):
                    continue
                a = np.asarray(x, np.float64).reshape(-1)
                if not np.isfinite(a).all():
                    continue
                with np.errstate(over="ignore"):
                    a = np.floor(a * scale)
                a = np.array([int(min(max(v, -(2.0**63)), 2.0**63 - 1024)) for v in a], np.int64) if (np.abs(a) >= 2.0**63).any() else a.astype(np.int64)
                keep.append(k)
                norms.append(float(np.sqrt((a.astype(np.float64) ** 2).sum())))
                packed.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(norms, pa.float64()), pa.array(packed, pa.binary())], ["vec_id", "norm", "q"])

    narrow = only(vectors, vec_id=id, v=vector)
    return narrow.select(F.col("vec_id").cast("long"), "v").mapInArrow(run, "vec_id long, norm double, q binary")


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Runs of at most `most` rows of each partition: (high double, low double, n int, block binary)."""

    def run(batches):
        ids, norms, qs = [], [], []

        def out():
            dim = max(len(x) for x in qs)
            m = np.frombuffer(b"".join(x.ljust(dim, b"\0") for x in qs), np.int64).reshape(len(qs), dim // 8) if dim else np.zeros((len(qs), 0), np.int64)
            small = m.size == 0 or np.abs(m).max() < 32_768
            blob = pack(np.array([len(qs), dim // 8, small], np.int64), np.array(ids, np.int64), np.array(norms), m.astype(np.int16) if small else m)
            return pa.RecordBatch.from_arrays([pa.array([max(norms)]), pa.array([min(norms)]), pa.array([len(ids)], pa.int32()), pa.array([blob], pa.binary())], ["high", "low", "n", "block"])

        for b in batches:
            for i, nm, q in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(i)
                norms.append(nm)
                qs.append(q)
                if len(ids) == most:
                    yield out()
                    ids, norms, qs = [], [], []
        if ids:
            yield out()

    return rows.select("vec_id", "norm", "q").mapInArrow(run, "high double, low double, n int, block binary")


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    head, ids, norms, m = unpack(blob)
    n, dim, small = np.frombuffer(head, np.int64)
    return np.frombuffer(ids, np.int64), np.frombuffer(norms), np.frombuffer(m, np.int16 if small else np.int64).reshape(n, dim).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly, held at the limits of 64 bits."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * dim
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


LEAST = -(2**63)


def best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k best allowed scores that reach the row's floor, ties to smaller ids."""
    s = np.where(allowed, scores, LEAST)
    if s.shape[1] > k:
        floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
    row, col = np.nonzero(allowed & (s >= floor[:, None]))
    order = np.lexsort((ids[col], -s[row, col].astype(np.float64), row)) if (np.abs(s[row, col].astype(np.float64)) < 2**53).all() else np.array(sorted(range(len(row)), key=lambda i: (row[i], -int(s[row[i], col[i]]), ids[col[i]])), np.int64)
    row, col = row[order], col[order]
    start = np.searchsorted(row, row)
    keep = np.arange(len(row)) - start < k
    return row[keep], col[keep]


def survivors(q: np.ndarray, norm: float, theta: float, m: np.ndarray, norms: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Indices within a bucket (by falling length) that may reach theta with q: by length, and if the bucket's local
    cosine threshold t is high, by the ranges that it leaves to the FOCUS largest coordinates of the unit vectors: of
    angles to an axis, those within acos(t) of the query's, so the axis itself is within where the query is that near."""
    reach = np.searchsorted(-norms, -(theta / norm) * (1 - 1e-9), side="right") if theta > 0 else len(norms)
    t = theta / (norm * norms[0]) * (1 - 1e-9) if theta > 0 and norms[0] else -1.0
    if t < COORDINATES_FROM or not reach:
        return np.arange(reach)
    t, live = min(t, 1.0), np.arange(reach)
    for f in np.argsort(-np.abs(q[: m.shape[1]]))[:FOCUS]:
        x = q[f] / norm
        # A share next to 1 is known to 1e-16, so the root to 1e-8.
        wide = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-7
        least, most = -np.inf if x <= -t else x * t - wide, np.inf if x >= t else x * t + wide
        u = unit[live, f]
        live = live[(u >= least) & (u <= most)]
    return live


class Asked:
    """A block of queries in a cell: what they found so far, and the k-th best score of each, which prunes what follows."""

    def __init__(self, blob: bytes, theta: bytes, k: int):
        self.ids, self.norms, self.q = _opened(blob)
        self.theta, self.k, self.rows, self.size = np.frombuffer(theta, np.int64).copy(), k, [], 0

    def meet(self, ci: np.ndarray, cn: np.ndarray, c: np.ndarray) -> None:
        """One bucket: each query prunes by length or by coordinates before its products are taken."""
        theta, qn, q, qi = self.theta, self.norms, self.q, self.ids
        with np.errstate(over="ignore"):
            local = np.where((theta > 0) & (qn * cn[0] > 0), theta / np.maximum(qn * cn[0], 1e-300), -1.0)
        local = np.where((theta > 0) & (qn * cn[0] == 0), 2.0, local)
        plain = np.flatnonzero(local < COORDINATES_FROM)
        if len(plain):
            reach = max(len(survivors(q[i], qn[i], theta[i], c, cn, cn)) for i in plain) if (theta[plain] > 0).all() else len(cn)
            s = products(q[plain], c[:reach])
            r, j = best(s, qi[plain][:, None] != ci[None, :reach], ci[:reach], theta[plain], self.k)
            self._keep(plain[r], ci[j], s[r, j])
        rest = np.flatnonzero((local >= COORDINATES_FROM) & (local <= 1 + 1e-9))
        unit = c / np.maximum(cn, 1e-300)[:, None] if len(rest) else None
        for i in rest:
            live = survivors(q[i], qn[i], theta[i], c, cn, unit)
            if len(live):
                s = products(q[i : i + 1], c[live])
                r, j = best(s, (ci[live] != qi[i])[None, :], ci[live], theta[i : i + 1], self.k)
                self._keep(np.full(len(j), i), ci[live][j], s[0, j])
        if self.size > 4 * self.k * len(qi):
            self.settle()

    def _keep(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self.rows.append((query, vec, score))
            self.size += len(query)

    def settle(self) -> None:
        """Only the k best of each query stay, ties to smaller ids."""
        query, vec, score = (np.concatenate(x) for x in zip(*self.rows))
        # ~score falls as score rises, without leaving 64 bits.
        turn = np.lexsort((vec, ~score, query))
        query, vec, score = query[turn], vec[turn], score[turn]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == self.k - 1
        self.theta[query[full]] = np.maximum(self.theta[query[full]], score[full])
        keep = place < self.k
        self.rows, self.size = [(query[keep], vec[keep], score[keep])], int(keep.sum())

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.settle()
        query, vec, score = self.rows[0]
        return self.ids[query], vec, score


def search(vectors: DataFrame, is_query: Column | None = None, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which is_query holds (of its id, named vec_id; none: all
    rows), the k rows of other ids with the highest inner products of the quantised vectors, ties to smaller ids.

    Rows with null ids take no part. Repeated rows are candidates each; equal queries are asked once. Shorter vectors
    count as if filled up with zeros. Products beyond 64 bits are held at the limit. Fewer than k others: all of them.

    Vectors are dealt by falling length, so a partition holds a range of lengths, cut into buckets; ties in length
    are dealt by id, so equal vectors spread. The longest bucket gives each query a k-th best score to start from.
    Groups of query blocks and groups of buckets span a grid. A cell whose lengths allow a product that high holds both
    groups once, packed, and keeps the k best of its queries as it goes from long buckets to short ones; so a bucket
    travels once for each group of queries, not for each block. An empty table gives an empty result; very long vectors
    make the groups of queries smaller."""
    rows = stored(quantised(vectors, id, vector).where(F.col("vec_id").isNotNull()), "vectors")
    n = rows.count()
    buckets = _blocks(rows.repartitionByRange(parts_for(n, 4 * BUCKET, 1), F.col("norm").desc(), "vec_id").sortWithinPartitions(F.col("norm").desc()), BUCKET)
    buckets = stored(buckets.withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    asked = rows.where(is_query) if is_query is not None else rows
    asked = asked.dropDuplicates(["vec_id", "q"])
    asked = _blocks(asked.repartition(parts_for(n, 64 * QUERIES, 1)), QUERIES)
    # One block of BUCKET vectors.
    first = buckets.orderBy(F.col("high").desc(), F.col("n").desc(), "bucket").select("block").first()
    first = rows.sparkSession.sparkContext.broadcast(bytes(first["block"]) if first else b"")

    def seed(batches):
        for b in batches:
            lows, thetas = [], []
            for blob in b.column("block").to_pylist():
                (qi, qn, q), (ci, _, c) = _opened(blob), _opened(first.value)
                s = np.where(qi[:, None] == ci[None, :], LEAST, products(q, c))
                theta = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(qi), LEAST)
                with np.errstate(divide="ignore", invalid="ignore"):
                    lows.append(float(np.where(theta > 0, theta / np.maximum(qn, 1e-300), -1).min()))
                thetas.append(theta.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(thetas, pa.binary()), pa.array(lows, pa.float64())], ["asked", "theta", "least"])

    asked = asked.mapInArrow(seed, "asked binary, theta binary, least double")
    asked = stored(asked.withColumn("q", F.monotonically_increasing_id()), "asked")
    # Groups of query blocks and groups of buckets, by names and lengths alone: a cell of the grid is a pair of groups.
    wide = rows.agg(F.max(F.octet_length("q"))).first()[0] or 8
    n_asked, n_buckets = asked.count(), buckets.count()
    tall = max(1, min(GRID[0], MEMORY // (QUERIES * max(8, wide)), n_asked // 16))
    broad = max(1, min(GRID[1], -(-n_buckets * -(-n_asked // tall) // CELLS)))
    rank = lambda df, by, each: df.withColumn("g", F.floor((F.row_number().over(Window.orderBy(*by)) - 1) / each))
    q_groups = stored(rank(asked.select("q", "least"), [F.col("least").desc(), "q"], tall), "qgroups")
    b_groups = stored(rank(buckets.select("bucket", "high"), [F.col("high").desc(), "bucket"], broad), "bgroups")
    cells = q_groups.groupBy(F.col("g").alias("qg")).agg(F.min("least").alias("least")).join(b_groups.groupBy(F.col("g").alias("bg")).agg(F.max("high").alias("high")), F.col("high") * (1 + 1e-9) >= F.col("least"))
    cells = stored(cells.select("qg", "bg"), "cells")
    ours = asked.select("q", "asked", "theta").join(q_groups.select("q", F.col("g").alias("qg")), "q").join(cells, "qg").select("qg", "bg", F.lit(0).alias("side"), F.lit(0.0).alias("high"), F.col("asked").alias("blob"), "theta")
    theirs = buckets.select("bucket", "high", "block").join(b_groups.select("bucket", F.col("g").alias("bg")), "bucket").join(cells, "bg").select("qg", "bg", F.lit(1).alias("side"), "high", F.col("block").alias("blob"), F.lit(b"").alias("theta"))

    def verify(batches):
        cell, held = None, []

        def out():
            found = [x.best() for x in held if x.rows]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["query_id", "vec_id", "score"])

        for b in batches:
            for qg, bg, side, blob, theta in zip(*(b.column(c).to_pylist() for c in ("qg", "bg", "side", "blob", "theta"))):
                if (qg, bg) != cell:
                    yield from out()
                    cell, held = (qg, bg), []
                if side == 0:
                    held.append(Asked(blob, theta, k))
                else:
                    ids, norms, m = _opened(blob)
                    for x in held:
                        x.meet(ids, norms, m)
        yield from out()

    dealt = ours.unionByName(theirs).repartition(parts_for(cells.count(), 1, 1, 20_000), "qg", "bg").sortWithinPartitions("qg", "bg", "side", F.col("high").desc())
    found = dealt.select("qg", "bg", "side", "blob", "theta").mapInArrow(verify, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
