"""Link relevance, priorities and the two-level frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .votes import majority

#: Weight of the parents; probabilities from which a URL is of the first and of the second level.
BETA, FIRST, SECOND = 0.25, 0.8, 0.5


def relevance(url_label: Column, url_prob: Column, anchor_label: Column, anchor_prob: Column) -> Column:
    vote = lambda y, p: F.struct(y.alias("label"), p.alias("prob"))
    return majority(F.array(vote(url_label, url_prob), vote(anchor_label, anchor_prob)))


def upsert(links: DataFrame) -> DataFrame:
    """links (url, parent_url, node_weight, label, prob) -> per URL its label and probability (of the likeliest), and what its
    distinct parents weigh. Order-free, so batches can be merged in any order."""
    parents = links.groupBy("url", "parent_url").agg(F.max("node_weight").alias("w"), F.max(F.struct("prob", (-F.col("label").cast("int")).alias("y"))).alias("b"))
    return parents.groupBy("url").agg(F.count("*").alias("n_parents"), F.avg("w").alias("mean_weight"), F.max("b").alias("b")).select("url", "n_parents", "mean_weight", F.col("b.prob").alias("prob"), (-F.col("b.y")).cast("string").alias("label"))


def priority(weight: Column, prob: Column, beta: float = BETA) -> Column:
    return beta * weight + (1 - beta) * prob


def levels(urls: DataFrame) -> DataFrame:
    """upsert's rows that are on topic and likely enough, with level 0 or 1 and priority; the mean weight of one parent is its own."""
    on = urls.where((F.col("label") == "0") & (F.col("prob") >= SECOND))
    return on.withColumns({"level": F.when(F.col("prob") >= FIRST, 0).otherwise(1), "priority": priority(F.col("mean_weight"), F.col("prob"))})


def next_urls(frontier: DataFrame, k: int) -> DataFrame:
    """The k best: level 0 before level 1, higher priorities first; a top-k, no full sort. request is the priority a fetcher gets."""
    return frontier.orderBy("level", F.col("priority").desc(), "url").limit(k).withColumn("request", F.round(F.col("priority") * 1000, 6))
