"""Folds share what is made without fitting."""

from pyspark.sql import functions as F

from gleaner.operators import models as K


def test_rows_are_hashed_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(k):
        made.add(1)
        return ["good", "fine"] if k % 2 else ["bad", f"w{k}"]

    df = spark.range(60).select((F.col("id") % 2).cast("double").alias("label"), tokens.asNondeterministic()("id").alias("tokens"))
    assert K.cross_validated(K.hashed(1 << 8), df) > 0.9 and made.value == 60
    rest, d = K.prepared(K.hashed(1 << 8), df)
    assert [type(s).__name__ for s in rest.getStages()] == ["IDF", "LogisticRegression"] and "tokens" not in d.columns
