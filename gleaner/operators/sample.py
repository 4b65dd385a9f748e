"""Samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(id: Column, seed: int = 1) -> Column:
    """A shuffled order that any engine repeats."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id.cast("string")))


def split(df: DataFrame, id: str, train: int, test: int, start: int = 0, seed: int = 1) -> DataFrame:
    """df's rows number start to start + train of a shuffled order as 'train', the next `test` as 'test': two top-k cuts."""
    k = order_key(F.col(id), seed)
    few = df.withColumn("_k", k).orderBy("_k", id).limit(start + train + test)
    n = F.row_number().over(Window.orderBy("_k", id)) - 1
    return few.withColumn("_n", n).where(F.col("_n") >= start).withColumn("part", F.when(F.col("_n") < start + train, "train").otherwise("test")).drop("_k", "_n")


def balanced(df: DataFrame, id: str, label: str, each: int, seed: int = 1) -> DataFrame:
    """For each label, `each` rows to train on and as many to test on."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(order_key(F.col(id), seed), id)) - 1
    return df.withColumn("_n", n).where(F.col("_n") < 2 * each).withColumn("part", F.when(F.col("_n") < each, "train").otherwise("test")).drop("_n")


def merged(positive: DataFrame, negative: DataFrame) -> DataFrame:
    return positive.withColumn("label", F.lit("0")).unionByName(negative.withColumn("label", F.lit("1")))


def one_against_rest(df: DataFrame, label: str, own: str) -> DataFrame:
    return df.withColumn("label", F.when(F.col(label) == own, "0").otherwise("1"))


def usable(df: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    return df.where(F.col(text).isNotNull() & (F.length(text) >= least))


def repeated(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def confident(df: DataFrame, least: float = 0.8, score: str = "prob") -> DataFrame:
    return df.where(F.col(score) > least)
