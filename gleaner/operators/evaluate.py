"""Metrics of predictions (columns truth and predicted unless named)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(p: DataFrame) -> DataFrame:
    return p.agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"))


def by_label(p: DataFrame) -> DataFrame:
    """(label, hit, n_predicted, n_true, precision, recall) of all labels on either side; 0 where nothing divides."""
    t = p.groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("n_true"), F.count_if(F.col("truth") == F.col("predicted")).alias("hit"))
    q = p.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("n_predicted"))
    j = t.join(q, "label", "full").select("label", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("hit", "n_predicted", "n_true")))
    rate = lambda n: F.coalesce(F.try_divide(F.col("hit"), F.col(n)), F.lit(0.0))
    return j.withColumns({"precision": rate("n_predicted"), "recall": rate("n_true")})


def report(metrics: DataFrame) -> DataFrame:
    """by_label's rates as percent with two places."""
    pct = lambda c: F.format_string("%.2f%%", F.round(F.col(c) * 100, 2)).alias(c)
    return metrics.select("label", pct("precision"), pct("recall"))


def micro_macro(p: DataFrame) -> DataFrame:
    """Accuracy over all rows, and the mean recall of the true labels."""
    each = p.groupBy("truth").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("hit"))
    return each.agg((F.sum("hit") / F.sum("n")).alias("micro"), F.avg(F.col("hit") / F.col("n")).alias("macro"))


def f_score(p: DataFrame, truth: str = "truth", value: str = "value") -> DataFrame:
    """Of labels 1 and -1 and values that count as 1 from 0 on."""
    tp, pp, pos = F.count_if((F.col(truth) == 1) & (F.col(value) >= 0)), F.count_if(F.col(value) >= 0), F.count_if(F.col(truth) == 1)
    c = p.agg(tp.alias("tp"), pp.alias("pp"), pos.alias("pos"))
    c = c.withColumns({"precision": F.coalesce(F.try_divide("tp", "pp"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", "pos"), F.lit(0.0))})
    return c.select("precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f_score"))


def regression(p: DataFrame, truth: str = "truth", value: str = "value") -> DataFrame:
    """Percent of equal values, mean squared error, squared correlation."""
    t, v = F.col(truth), F.col(value)
    return p.agg((100 * F.avg((t == v).cast("double"))).alias("accuracy"), F.avg(F.pow(v - t, 2)).alias("mse"), F.pow(F.corr(t, v), 2).alias("r2"))


def trimmed_mean(p: DataFrame, key: str, value: str, least: float = 0.01) -> DataFrame:
    """Mean of the values over `least` without one smallest and one greatest: three aggregates, no order."""
    kept = p.where(F.col(value) > least)
    s, n = F.sum(value), F.count("*")
    return kept.groupBy(key).agg(F.when(n > 2, (s - F.min(value) - F.max(value)) / (n - 2)).alias("mean"), n.alias("n"))


def overlap_score(a: DataFrame) -> DataFrame:
    """(.., candidate array, gold array) -> P, R, F1 and score from the words both hold, as a set."""
    n = F.size(F.array_intersect("candidate", "gold")).cast("double")
    c, g = F.size(F.array_distinct("candidate")), F.size(F.array_distinct("gold"))
    a = a.withColumns({"p": F.coalesce(F.try_divide(n, c), F.lit(0.0)), "r": F.coalesce(F.try_divide(n, g), F.lit(0.0)), "score": F.coalesce(F.try_divide(n, c + g - n), F.lit(0.0))})
    return a.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))


def lcs_score(a: DataFrame) -> DataFrame:
    """As overlap_score, from the longest common subsequence of the words in order."""
    from ..functions.text import lcs

    a = a.withColumn("lcs", lcs("candidate", "gold").cast("double"))
    c, g = F.size("candidate"), F.size("gold")
    a = a.withColumns({"p": F.coalesce(F.try_divide("lcs", c), F.lit(0.0)), "r": F.coalesce(F.try_divide("lcs", g), F.lit(0.0)), "score": F.coalesce(F.try_divide(F.col("lcs"), c + g - F.col("lcs")), F.lit(0.0))})
    return a.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))


def paired(candidates: DataFrame, gold: DataFrame, prefix: str = "C_") -> DataFrame:
    """Candidates (name, candidate) whose name is prefix + that of a gold row (name, gold)."""
    return gold.join(candidates.withColumnRenamed("name", "c"), F.concat(F.lit(prefix), "name") == F.col("c")).drop("c")


def aligned(truth: DataFrame, predicted: DataFrame, on: str) -> DataFrame:
    """Rows of both sides by key; those that miss on one are left out."""
    return truth.join(predicted, on)


def lines_aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, pos, left, right) of two texts' lines by place."""
    x = a.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "left"))
    y = b.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "right"))
    return x.join(y, [key, "pos"])


def checked(articles: DataFrame, gold: DataFrame, words) -> DataFrame:
    """One row (n, p, r, f1, score): means over the pages that articles (page_id, para) and gold (page_id, gold text) share, of
    scores over 0.01 and without one least and one greatest, all in one pass; words parts a text."""
    pairs = aligned(articles.select("page_id", words(F.col("para")).alias("candidate")), gold.select("page_id", words(F.col("gold")).alias("gold")), "page_id")
    means = {}
    for c in ("p", "r", "f1", "score"):
        kept = F.when(F.col(c) > 0.01, F.col(c))
        n = F.count(kept)
        means[c] = F.when(n > 2, (F.sum(kept) - F.min(kept) - F.max(kept)) / (n - 2))
    return lcs_score(pairs).agg(F.count("*").alias("n"), *(m.alias(c) for c, m in means.items()))
