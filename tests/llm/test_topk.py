import math

import numpy as np
import pytest
from compare import duck, of_spark

from gleaner.llm import topk
from gleaner.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F


def brute(rows, is_query, k=5):
    ok = [(i, np.array([math.floor(256 * float(np.float32(x))) for x in v], dtype=object)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in ok if is_query(i)}):
        for q in [v for j, v in ok if j == i][:1]:
            found = sorted(((-int(sum(a * b for a, b in zip(q, v))), j) for j, v in ok if j != i))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return out


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_sql(spark, sf):
    assert of_spark(QUERIES["op1_topk_search"](spark, sf)) == duck(sf, ORACLE_SQL["op1_topk_search"])


@pytest.mark.parametrize("bucket", [7, 4096])
def test_brute_force(spark, monkeypatch, bucket):
    """Many buckets of unlike lengths, near-parallel vectors (coordinates prune), ties, nulls and repeated rows."""
    monkeypatch.setattr(topk, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=6)
    rows = [(k, [float(x) for x in (centre + rng.normal(size=6) * 0.05) * rng.choice([0.1, 1, 5])]) for k in range(150)]
    rows += [(k, [float(x) for x in rng.normal(size=6)]) for k in range(150, 300)]
    rows += [(300 + k, rows[10][1]) for k in range(12)]
    rows += [(400, None), (401, [1.0, None] * 3), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, [0.0] * 6), (None, [1.0] * 6), (405, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, norm int, q string")
    assert got(topk.search(df.repartition(4), F.col("vec_id") % 5 == 0)) == brute(rows, lambda i: i % 5 == 0)


@pytest.mark.parametrize("lengths", [[1.0], [0.5, 1.0, 1.1, 4.0]])
def test_dominant_coordinate(spark, monkeypatch, lengths):
    """Tight groups about an axis, on both sides of it: the axis itself, nearer and farther vectors, copies of queries."""
    monkeypatch.setattr(topk, "BUCKET", 16)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(240):
        v = rng.normal(size=8) * rng.choice([0.0, 0.05, 0.2])
        v[k % 2] += rng.choice([-1, 1]) if k % 3 else 1
        rows.append((k, [float(x) for x in v / np.linalg.norm(v) * rng.choice(lengths)]))
    rows += [(300 + k, rows[5 * k][1]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(topk.search(df.repartition(4), F.col("vec_id") % 5 == 0)) == brute(rows, lambda i: i % 5 == 0)


def test_survivors_hold_all_that_reach():
    """Queries nearer to an axis than the local threshold, and farther."""
    rng = np.random.default_rng(6)
    for x in (-0.95, -0.9, -0.75, 0.6, 0.75, 0.9, 0.95, 1.0):
        m = rng.normal(size=(400, 4)) * rng.choice([0.0, 0.1, 0.5], size=(400, 1)) + np.array([np.sign(x), 0, 0, 0])
        m = np.floor(m / np.linalg.norm(m, axis=1)[:, None] * 256).astype(np.int64)
        q = np.floor(256 * np.array([x, np.sqrt(max(0, 1 - x * x)), 0, 0])).astype(np.int64)
        m = np.concatenate([m, q[None, :]])
        norms = np.linalg.norm(m.astype(float), axis=1)
        m, norms = m[np.argsort(-norms)], np.sort(norms)[::-1]
        norm, s = float(np.linalg.norm(q.astype(float))), m @ q
        for theta in (int(t * norm * norms[0]) for t in (0.71, 0.8, 0.92)):
            live = topk.survivors(q, norm, theta, m, norms, m / norms[:, None])
            assert set(np.flatnonzero(s >= theta)) <= set(live), (x, theta)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0, 2.0]), (7, [-3.0, 0.5])], "vec_id long, embedding array<float>")
    assert got(topk.search(df, F.col("vec_id") % 50 == 0)) == brute([tuple(r) for r in df.collect()], lambda i: i % 50 == 0)
    assert topk.search(df.where("vec_id < 0")).count() == 0
    assert topk.search(df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("cells,queries", [(3, 8), (4_096, 8), (4, 2)])
def test_grid(spark, monkeypatch, cells, queries):
    """Groups of several query blocks and buckets, and the k best of a cell kept as it goes."""
    for name, value in {"BUCKET": 16, "QUERIES": queries, "CELLS": cells, "GRID": (3, 5) if queries > 2 else (32, 64)}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.normal(size=5) * rng.choice([0.2, 1, 3])]) for k in range(400)] + [(500 + k, [0.5] * 5) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(topk.search(df.repartition(4), F.col("vec_id") % 3 == 0)) == brute(rows, lambda i: i % 3 == 0)
