"""Vocabularies hold every term of two or more documents, however many there are."""

from gleaner.operators import models as K
from pyspark.sql import functions as F


def _corpus(spark, terms, per=500):
    """Rare terms, each in two documents, and one that tells the labels and is rarer than the others are."""
    of = lambda k: [f"t{i:05}" for i in range(k * per, (k + 1) * per) for _ in range(2)]
    rows = [(2 * k + h, float(h), of(k) + ["common"] * 3) for k in range(terms // per) for h in (0, 1)]
    rows += [(10_000 + k, 1.0, ["telling"]) for k in range(2)] + [(20_000 + k, 0.0, ["common"]) for k in range(2)]
    return spark.createDataFrame(rows, "doc_id long, label double, tokens array<string>")


def test_binary_holds_all_terms(spark):
    df = _corpus(spark, 18_000)
    count = df.select("doc_id", F.explode(F.array_distinct("tokens")).alias("t")).groupBy("t").count().where("count >= 2").count()
    assert count == 18_002
    assert set(K.binary().getStages()[0].fit(df).vocabulary) >= {"telling", "t00000", "t17999"}
    m = K.binary(select=False).fit(df)
    assert len(m.stages[0].vocabulary) == count
    # No other term tells the labels.
    assert {r["prediction"] for r in K.scored(m, df.where("doc_id >= 10000 and doc_id < 20000")).collect()} == {1.0}


def test_topics_hold_all_terms(spark):
    df = _corpus(spark, 9_000)
    t = K.topics(df, k=2, iterations=1, words=20_000)
    assert t.where("topic = 0").select("term").distinct().count() == 9_002
