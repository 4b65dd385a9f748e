"""Steps in Python hold a stretch of rows, however many come in one batch."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import dom as D
from gleaner.operators import evaluate as E
from gleaner.operators import models as K
from gleaner.operators import records as W


@pytest.fixture
def worker(spark, monkeypatch):
    """What mapInArrow would run, instead of its rows."""
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: run)


PAGE = "<html><body>" + "<div><p>some words {}</p><a href='/x'>go</a></div>" * 30 + "</body></html>"


@pytest.mark.parametrize("made", [D.nodes, D.paths, D.structure])
def test_pages_leave_by_stretches(spark, worker, made):
    run = made(spark.createDataFrame([(1, "")], "page_id long, html string"))
    b = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([PAGE] * 400)], ["page_id", "html"])
    sizes = [x.num_rows for x in run([b])]
    assert len(sizes) > 1 and max(sizes) <= D.ROWS and sum(sizes) == 400 * len(D.parse(PAGE))


def test_texts_leave_by_stretches(spark, worker):
    run = D.trees(spark.createDataFrame([(1, "")], "page_id long, html string"), lambda tree: [(W.main_text(tree)[1] * 40,)], "para string")
    b = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([PAGE] * 400)], ["page_id", "html"])
    sizes = [x.column(1).nbytes for x in run([b])]
    assert len(sizes) > 1 and max(sizes) < 2 * D.LETTERS


def test_paths_are_those_of_the_structure(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    assert sorted(map(tuple, D.paths(p).collect())) == sorted(map(tuple, D.structure(p).select("page_id", "node_id", "xpath").collect()))


def test_subsequences_take_arrow_arrays():
    a, b = pa.array([["x", "y"], None, []]), pa.array([["y", "x", "xy"], ["x"], ["x"]])
    assert T.lcs.func(a, b).to_pylist() == [1, 0, 0] and T.lcs_within.func(a, b).to_pylist() == [2, 0, 0]


def test_check_scores_once(spark):
    articles = spark.createDataFrame([(k, "a b c d"[: 1 + 2 * (k % 4)]) for k in range(9)], "page_id long, para string")
    gold = articles.select("page_id", F.lit("a b c d").alias("gold"))
    got = E.checked(articles, gold, T.words)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    r = sorted((1 + k % 4) / 4 for k in range(9))
    assert (got.first()["n"], got.first()["p"]) == (9, 1.0) and math.isclose(got.first()["r"], sum(r[1:-1]) / 7)
    assert tuple(E.checked(articles.limit(0), gold, T.words).first()) == (0, None, None, None, None)


def test_least_squares_over_many_batches(spark, worker):
    run = K.rls(spark.createDataFrame([("a", 1, 1.0, 1.0)], "k string, i long, x double, y double"), "k", "i", ["x"], "y")
    keys, x, y = [None] * 3 + ["a"] * 5 + ["b"], np.arange(9.0), [1.0, None, 3.0, 4.0, 5.5, math.inf, 7.0, 8.0, 9.0]
    whole = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(range(9)), pa.array(x), pa.array(y)], ["k", "i", "x", "y"])
    one = [b.to_pylist()[0] for b in run([whole])]
    assert [b.to_pylist()[0] for b in run([whole.slice(k, 2) for k in range(0, 9, 2)])] == one
    assert [(r["k"], r["n"]) for r in one] == [(None, 3), ("a", 5), ("b", 1)]
    w, p = np.zeros(2), np.eye(2) / 1e-4
    for k in (3, 4, 6, 7):
        w, p = K.rls_step(w, p, np.array([1.0, x[k]]), y[k])
    assert np.allclose(one[1]["w"], w)
