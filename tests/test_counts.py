"""Counts within rows, looked-up values and sums, with ids and texts that repeat, are empty or null."""

import math

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import terms as M

ROWS = [(1, "a", "x y x"), (1, "a", "x z"), (2, "b", "y y y"), (3, "b", ""), (None, "a", "w"), (None, "a", "w x"), (4, None, "q x")]


def corpus(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, label string, text string")


def exchanges(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("HashAggregate"), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_counted(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,), (["é"],)], "a array<string>")
    assert [r[0] for r in df.select(T.counted(F.col("a"))).collect()] == [[("a", 1), ("b", 2)], [], None, [("é", 1)]]


def test_rows_are_counted_without_an_exchange(spark):
    c = corpus(spark, [r for r in ROWS if r[0] not in (1, None)])
    assert exchanges(M.per_document(c, T.grams(T.words(F.col("text"))), "gram")) == (0, 0)


def test_ids_that_repeat_are_one_document(spark):
    got = sorted(map(tuple, M.per_document(corpus(spark), T.words(F.col("text"))).collect()), key=repr)
    assert got == sorted([(1, "x", 3), (1, "y", 1), (1, "z", 1), (2, "y", 3), (None, "w", 2), (None, "x", 1), (4, "q", 1), (4, "x", 1)], key=repr)
    a = {(r["tok"], r["label"]): r["a"] for r in M.class_counts(corpus(spark)).collect()}
    assert (a["x", "a"], a["w", "a"], a["y", "b"], a["x", None]) == (2, 1, 1, 1)


@pytest.mark.parametrize("hot", [0, 2, 100])
def test_features_by_hot_words(spark, monkeypatch, hot):
    monkeypatch.setattr(M, "HOT", hot)
    c = corpus(spark).where("label is not null")
    want = {(r[0], r[1]): r[2] for r in M.features(M.tokens(c), M.weight_rf(M.class_counts(c)), "tf").collect()}
    got = {(r[0], r[1]): r[2] for r in M.corpus_features(c, M.weight_rf).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    sums = {r["doc_id"]: (r["total"], r["n"]) for r in M.feature_sums(c, M.weight_rf).collect()}
    for i, (total, n) in sums.items():
        own = [v for k, v in want.items() if k[0] == i]
        assert n == len(own) and math.isclose(total, sum(own))


@pytest.mark.parametrize("hot", [0, 3, 100])
def test_totals_by_hot_grams(spark, monkeypatch, hot):
    monkeypatch.setattr(M, "HOT", hot)
    c = corpus(spark)
    f = M.gram_features(c, M.label_ratios(c)).groupBy("doc_id", "label").agg(F.sum("value").alias("t"), F.count("*").alias("n"))
    want = {(r[0], r[1]): (r[2], r[3]) for r in f.collect()}
    got = {(r["doc_id"], r["label"]): (r["total"], r["n_grams"]) for r in M.gram_totals(c).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and math.isclose(got[k][0], want[k][0]) for k in want)
    assert M.gram_totals(c.where("label is null")).count() == 0
