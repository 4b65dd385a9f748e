"""Votes: labels '0' (on topic) and '1', with probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ternary(label: Column, prob: Column, least: float = 0.7) -> Column:
    """0 for an unsure vote, else 1 on topic and -1 off it."""
    return F.when(prob < least, 0).when(label == "0", 1).otherwise(-1)


#: The weights of a document's fields.
FIELDS = {"title": 3, "headlines": 2, "meta": 2, "para": 1}


def document(fields: dict[str, tuple[Column, Column, Column]], url_label: Column, url_prob: Column, weights: dict[str, int] = FIELDS) -> tuple[Column, Column]:
    """(label, probability) of a document: fields (text, label, probability) of more than 2 characters vote with their
    weights, no majority against is on topic, the probability is the highest of the fields that agree; then the URL's
    vote: agreement takes the higher probability, otherwise the likelier of the two wins, the text on a tie."""
    total = sum((F.when(F.length(t) > 2, ternary(y, p) * weights[k]).otherwise(0) for k, (t, y, p) in fields.items()), F.lit(0))
    label = F.when(total >= 0, "0").otherwise("1")
    prob = F.greatest(*(F.when((F.length(t) > 2) & (y == label), p).otherwise(0.0) for t, y, p in fields.values()))
    return F.when((label == url_label) | (prob >= url_prob), label).otherwise(url_label), F.greatest(prob, url_prob)


def majority(votes: Column, least: float = 0.5) -> Column:
    """Struct (label, prob) of an array of (label, prob): votes from `least` on count, the most frequent label wins, on a
    tie that of the higher probability, then the smaller; its probability is its highest. Null without votes."""
    sure = F.filter(votes, lambda v: v["prob"] >= least)
    labels = F.array_distinct(F.transform(sure, lambda v: v["label"]))

    def ranked(y: Column) -> Column:
        own = F.filter(sure, lambda v: v["label"] == y)
        return F.struct((-F.size(own)).alias("n"), (-F.array_max(F.transform(own, lambda v: v["prob"]))).alias("m"), y.alias("label"))

    best = F.array_min(F.transform(labels, ranked))
    return F.when(F.size(sure) > 0, F.struct(best["label"].alias("label"), (-best["m"]).alias("prob")))


def anchor_rule(text: Column, positive: tuple[str, ...]) -> Column:
    """Struct of what needs no model, else null: short texts are '0' at 0, a positive word is '0' at 1."""
    hit = F.arrays_overlap(F.split(F.lower(text), r"\W+"), F.array(*map(F.lit, positive)))
    vote = lambda y, p: F.struct(F.lit(y).alias("label"), F.lit(p).alias("prob"))
    return F.when(text.isNull() | (F.length(text) < 2), vote("0", 0.0)).when(hit, vote("0", 1.0))


def para_rule(text: Column) -> Column:
    return F.when(text.isNull() | (F.length(text) < 10), F.struct(F.lit("0").alias("label"), F.lit(0.0).alias("prob")))


def url_rule(tokens: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """Negative words before positive ones."""
    has = lambda w: F.arrays_overlap(tokens, F.array(*map(F.lit, w)))
    vote = lambda y: F.struct(F.lit(y).alias("label"), F.lit(1.0).alias("prob"))
    return F.when(has(negative), vote("1")).when(has(positive), vote("0"))


def url_and_text(url_label: Column, url_prob: Column, text_label: Column, text_prob: Column) -> Column:
    """The text's label, unless the URL's is likelier and the text's below 0.9."""
    return F.when((url_label != text_label) & (url_prob > text_prob) & (text_prob < 0.9), url_label).otherwise(text_label)


def two_views(p1: Column, p2: Column, seed: Column) -> Column:
    """Label 1 or 0 of two views' probabilities of 1: theirs if they agree, else that of the greater sum, else by the seed."""
    a, b = p1 >= 0.5, p2 >= 0.5
    return F.when(a == b, a.cast("int")).when(p1 + p2 > 1, 1).when(p1 + p2 < 1, 0).otherwise(F.pmod(F.ascii(F.md5(seed.cast("string"))), F.lit(2)))


def one_vs_one(values: DataFrame) -> DataFrame:
    """values (id, vals array of decision values, pairs (0,1), (0,2), ... of n classes) -> (id, winner, score).

    A positive value is a vote for the first of its pair. Most votes win, the smaller class on a tie; of the values of
    the k pairs it wins, score = sum(|v|) / (2k) + k / (2(n - 1))."""
    n = (F.lit(1) + F.floor(F.sqrt(2 * F.size("vals") + 1))).cast("int")
    v = values.withColumn("n", n).select("id", "n", "vals", F.explode(F.expr("flatten(transform(sequence(0, n - 2), i -> transform(sequence(i + 1, n - 1), j -> named_struct('i', i, 'j', j, 'at', cast(i * n - i * (i + 1) / 2 + j - i - 1 as int)))))")).alias("p"))
    v = v.withColumn("v", F.get("vals", F.col("p.at")))
    won = v.select("id", "n", F.when(F.col("v") > 0, F.col("p.i")).otherwise(F.col("p.j")).alias("class"), F.abs("v").alias("m"))
    each = won.groupBy("id", "n", "class").agg(F.count("*").alias("k"), F.sum("m").alias("s"))
    top = each.groupBy("id", "n").agg(F.min(F.struct((-F.col("k")).alias("k"), "class", "s")).alias("t"))
    k = -F.col("t.k")
    return top.select("id", F.col("t.class").alias("winner"), (F.col("t.s") / (2 * k) + k / (2 * (F.col("n") - 1))).alias("score"))


def field_variants(docs: DataFrame) -> DataFrame:
    """(.., variant, text): the text compositions that are compared: para, meta, title + meta (1 to 3 times) + para."""
    parts = {"para": ["para"], "meta": ["meta"], **{f"title_meta{k}_para": ["title", *["meta"] * k, "para"] for k in (1, 2, 3)}}
    keep = [c for c in docs.columns if c not in ("para", "meta", "title")]
    rows = F.array(*(F.struct(F.lit(k).alias("variant"), F.concat_ws(" ", *v).alias("text")) for k, v in parts.items()))
    return docs.select(*keep, F.explode(rows).alias("v")).select(*keep, "v.variant", "v.text")
