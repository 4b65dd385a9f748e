"""Term statistics, feature selection and weights. Tables: tokens (doc_id, pos, tok); corpus (doc_id, label, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import checkpointed

#: Words (the most frequent) whose values are broadcast where they are looked up; those of all others are joined.
HOT = 1 << 17


def tokens(docs: DataFrame, words: Column | None = None) -> DataFrame:
    """(doc_id, pos, tok[, label]) of docs (doc_id, text[, label])."""
    keep = [c for c in ("label",) if c in docs.columns]
    return docs.select("doc_id", *keep, F.posexplode(T.words(F.col("text")) if words is None else words).alias("pos", "tok"))


def by_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs whose doc_id stands on one row, and those of the others, None if there are none: only these need an exchange to meet."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("_m")).where("_m > 1").select(F.col("doc_id").alias("_id"))
    if ids.isEmpty():
        return docs, None
    ids, same = checkpointed(ids), F.col("doc_id").eqNullSafe(F.col("_id"))
    return docs.join(ids, same, "left_anti"), docs.join(ids, same, "left_semi")


def per_document(docs: DataFrame, items: Column, name: str = "tok", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep.., name, n): the distinct items of each document (an array of its row) and how often each stands there,
    counted within the row."""
    keys, (one, more) = ["doc_id", *keep], by_ids(docs)
    out = one.select(*keys, F.inline(T.counted(items)).alias(name, "n"))
    if more is None:
        return out
    return out.unionByName(more.select(*keys, F.explode(items).alias(name)).groupBy(*keys, name).agg(F.count("*").alias("n")))


def looked_up(pairs: DataFrame, values: DataFrame, by: str, often: str) -> DataFrame:
    """pairs with the values of their words, as an inner join by the column `by`. Values of the HOT words that `often` says are
    the most frequent are broadcast, so only the other words' pairs travel."""
    hot = checkpointed(values.orderBy(F.col(often).desc(), by).limit(HOT))
    few = F.broadcast(hot)
    rest = pairs.join(F.broadcast(hot.select(by)), by, "left_anti").join(values, by)
    return pairs.join(few, by).unionByName(rest)


def frequencies(docs: DataFrame, words: Column | None = None) -> DataFrame:
    """(tok, tf, df) of docs: occurrences and documents. A document's words are counted within its row, and both counts are
    pre-aggregated before one exchange on the word."""
    ws = T.words(F.col("text")) if words is None else words
    return docs.select(F.inline(T.counted(ws)).alias("tok", "n")).groupBy("tok").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def rows(df: DataFrame) -> Column:
    """Their number, as a scalar subquery."""
    return df.agg(F.count("*")).scalar()


def idf(df: Column, n: Column) -> Column:
    """ln(n div df + 0.01), whole division."""
    return F.log(F.floor(n / df) + 0.01)


def degrees(docs: DataFrame) -> DataFrame:
    """(tok, ldc): of the corpus's distinct word pairs, those that hold the word, twice if it is both."""
    pairs = docs.select(F.explode(F.array_distinct(T.bigrams(T.words(F.col("text"))))).alias("pair")).distinct()
    return pairs.select(F.explode(F.split("pair", " ")).alias("tok")).groupBy("tok").agg(F.count("*").alias("ldc"))


def statistics(docs: DataFrame) -> DataFrame:
    """(tok, tf, df, idf, tfidf, ldc), ldc 1 where a word has no pair."""
    f = frequencies(docs).withColumn("n", rows(docs))
    f = f.withColumn("idf", idf(F.col("df"), F.col("n"))).withColumn("tfidf", F.col("tf") * F.col("idf"))
    return f.join(degrees(docs), "tok", "left").select("tok", "tf", "df", "idf", "tfidf", F.coalesce("ldc", F.lit(1)).alias("ldc"))


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """df's rows numbered from 1 on in this order. The sorted rows are stored with their partitions, whose sizes say what
    stands before each, so no task holds or numbers them all."""
    kept = checkpointed(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_m"))
    before = sizes.select("_part", F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = kept.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return inner.join(F.broadcast(before), "_part").withColumn(name, F.col("_k") + F.col("_before")).drop("_part", "_k", "_before")


def thresholds(stats: DataFrame, ratio: float) -> DataFrame:
    """One row: the tfidf and the ldc that stand at the ratio's place when sorted from the highest down; null without words."""
    stats = checkpointed(stats)
    v = stats.count()
    place = min(v, int(v * ratio) + 1)
    at = lambda c: numbered(stats.select(c), F.col(c).desc()).where(F.col("number") == place).agg(F.max(c)).scalar()
    return stats.sparkSession.range(1).select(at("tfidf").alias("t_tfidf"), at("ldc").alias("t_ldc"))


def popular(stats: DataFrame, least_tfidf: float, most_ldc: int) -> DataFrame:
    return stats.where((F.col("tfidf") > least_tfidf) & (F.col("ldc") < most_ldc))


def rare(stats: DataFrame, least_tfidf: float, common_tfidf: float, most_ldc: int, k: int) -> DataFrame:
    """Few pairs and enough weight; or pairs strictly within one of k doubling ranges and the common weight."""
    bands = F.exists(F.sequence(F.lit(1), F.lit(k)), lambda i: (F.col("ldc") > F.pow(F.lit(2), i - 1) * most_ldc) & (F.col("ldc") < F.pow(F.lit(2), i) * most_ldc))
    return stats.where(((F.col("ldc") < most_ldc) & (F.col("tfidf") > least_tfidf)) | (bands & (F.col("tfidf") > common_tfidf)))


def keywords(stats: DataFrame, least: float = 500, most_ldc: int = 150) -> DataFrame:
    return popular(stats, least, most_ldc).orderBy(F.col("tfidf").desc(), "tok")


def top_keywords(docs: DataFrame, k: int = 50) -> DataFrame:
    """(doc_id, tok, weight, rank): each document's k words of the highest tf * idf, ties by word."""
    t = per_document(docs, T.words(F.col("text"))).withColumnRenamed("n", "tf")
    df = checkpointed(t.groupBy("tok").agg(F.count("*").alias("df")))
    w = looked_up(t, df, "tok", "df").withColumn("n", rows(docs))
    w = w.withColumn("weight", F.round(F.col("tf") * idf(F.col("df"), F.col("n")), 9))
    return w.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("weight").desc(), "tok"))).where(F.col("rank") <= k).select("doc_id", "tok", "weight", "rank")


def _filled(found: DataFrame, key: str, count: str, labels: Column) -> DataFrame:
    """found (key, label, count), one row for each -> (key, count, label, size, total): all labels for each key, 0 where none
    was found, with the key's total. Labels (an array of label and size) are few: a key's counts fit in one row, and
    one exchange on the key does it."""
    one = found.groupBy(key).agg(F.collect_list(F.struct("label", count)).alias("x"), F.sum(count).alias("total"))
    each = one.select(key, "x", "total", F.explode(labels).alias("l"))
    own = F.get(F.filter("x", lambda v: v["label"].eqNullSafe(F.col("l.label"))), F.lit(0))[count]
    return each.select(key, F.col("l.label").alias("label"), F.col("l.size").alias("size"), F.coalesce(own, F.lit(0).cast("long")).alias(count), "total")


def class_counts(corpus: DataFrame) -> DataFrame:
    """(tok, label, a, b, c, d): documents of the label with the word, of others with it, of the label without, of others without. All labels for each word."""
    docs = corpus.groupBy("label").agg(F.count("*").alias("size"))
    labels = docs.agg(F.collect_list(F.struct("label", "size"))).scalar()
    one, more = by_ids(corpus)
    own = lambda d: d.select("doc_id", "label", F.explode(F.array_distinct(T.words(F.col("text")))).alias("tok"))
    seen = own(one) if more is None else own(one).unionByName(own(more).distinct())
    found = seen.groupBy("tok", "label").agg(F.count("*").alias("a"))
    all_ = _filled(found, "tok", "a", labels).withColumn("n", rows(corpus))
    b = F.col("total") - F.col("a")
    return all_.select("tok", "label", "a", b.alias("b"), (F.col("size") - F.col("a")).alias("c"), (F.col("n") - F.col("size") - b).alias("d"), "n")


def chi_reduced(counts: DataFrame) -> DataFrame:
    """Greatest (ad - bc)^2 over the product of the label's documents and the others'."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    return counts.groupBy("tok").agg(F.max(F.coalesce(F.try_divide(F.pow(a * d - b * c, 2), (a + c) * (b + d)), F.lit(0.0))).alias("chi"))


def chi_full(counts: DataFrame) -> DataFrame:
    a, b, c, d, n = (F.col(x).cast("double") for x in "abcdn")
    return counts.groupBy("tok").agg(F.max(F.coalesce(F.try_divide(n * F.pow(a * d - b * c, 2), (a + c) * (b + d) * (a + b) * (c + d)), F.lit(0.0))).alias("chi"))


def weight_idf(counts: DataFrame) -> DataFrame:
    """ln(n / (df + 1)), which may be negative."""
    return counts.groupBy("tok").agg(F.log(F.max("n") / (F.sum("a") + 1)).alias("weight"))


def weight_rf(counts: DataFrame) -> DataFrame:
    return counts.groupBy("tok").agg(F.max(F.log(2 + F.col("a") / F.greatest(F.lit(1), F.col("b")))).alias("weight"))


def weight_one(counts: DataFrame) -> DataFrame:
    return counts.select("tok").distinct().withColumn("weight", F.lit(1.0))


GLOBAL = {"idf": weight_idf, "rf": weight_rf, "one": weight_one}
LOCAL = {"tf": lambda n: n.cast("double"), "logtf": lambda n: F.log(n), "binary": lambda n: F.when(n > 0, 1.0).otherwise(0.0)}


def top_ratio(scores: DataFrame, ratio: float = 0.5, by: str = "chi") -> DataFrame:
    """The floor(V * ratio) words of the highest scores, ties by word."""
    scores = checkpointed(scores)
    n = int(scores.count() * ratio)
    return numbered(scores, F.col(by).desc(), "tok").where(F.col("number") <= n).drop("number")


def vocabulary(toks: DataFrame, least: int = 1) -> DataFrame:
    """(tok, id) of the words that occur `least` times, from 1 on, frequent words first."""
    f = toks.groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return numbered(f, F.col("n").desc(), "tok", name="id").select("tok", "id")


def first_seen(toks: DataFrame) -> DataFrame:
    """(tok, id): words numbered from 0 on as documents (by id) and their words (by place) bring them up."""
    f = toks.groupBy("tok").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    return numbered(f.select("tok", "at.doc_id", "at.pos"), "doc_id", "pos", "tok", name="id").select("tok", (F.col("id") - 1).alias("id"))


def features(toks: DataFrame, weights: DataFrame, local: str = "tf") -> DataFrame:
    """(doc_id, tok, value): local weight times global weight, L2-normalised within each document."""
    t = toks.groupBy("doc_id", "tok").agg(F.count("*").alias("n")).join(weights, "tok")
    return _normalised(t.withColumn("v", LOCAL[local](F.col("n")) * F.col("weight")))


def _normalised(t: DataFrame) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("doc_id")))
    return t.withColumn("norm", norm).select("doc_id", "tok", F.when(F.col("norm") > 0, F.col("v") / F.col("norm")).otherwise(0.0).alias("value"))


def weighted(corpus: DataFrame, weight, local: str = "tf") -> DataFrame:
    """(doc_id, tok, v): local weight times global weight (a function of the class counts) of each document's words."""
    counts = class_counts(corpus)
    both = checkpointed(weight(counts).join(counts.groupBy("tok").agg(F.sum("a").alias("df")), "tok"))
    t = looked_up(per_document(corpus, T.words(F.col("text"))), both, "tok", "df")
    return t.select("doc_id", "tok", (LOCAL[local](F.col("n")) * F.col("weight")).alias("v"))


def corpus_features(corpus: DataFrame, weight, local: str = "tf") -> DataFrame:
    """As features, of a corpus's own words and weights."""
    return _normalised(weighted(corpus, weight, local))


def feature_sums(corpus: DataFrame, weight, local: str = "tf") -> DataFrame:
    """(doc_id, total, n): of each document, the sum of its features and their number. Sums of values and of squares are
    pre-aggregated, so no word travels to its document."""
    v = F.col("v")
    s = weighted(corpus, weight, local).groupBy("doc_id").agg(F.sum(v).alias("s"), F.sqrt(F.sum(v * v)).alias("norm"), F.count("*").alias("n"))
    return s.select("doc_id", F.when(F.col("norm") > 0, F.col("s") / F.col("norm")).otherwise(0.0).alias("total"), "n")


def gram_counts(corpus: DataFrame) -> DataFrame:
    """(label, gram, n): occurrences of words and word pairs."""
    g = corpus.select("label", F.explode(T.grams(T.words(F.col("text")))).alias("gram"))
    return g.groupBy("label", "gram").agg(F.count("*").alias("n"))


def label_counts(corpus: DataFrame) -> tuple[list, DataFrame]:
    """The labels, and (gram, ns array<long>): occurrences of each gram by label, in the labels' order. Labels are few, so
    one exchange on the gram carries pre-aggregated counts of them all."""
    labels = [r[0] for r in corpus.select("label").where("label is not null").distinct().orderBy("label").collect()]
    if not labels:
        return [], corpus.select(F.lit("").alias("gram"), F.array().cast("array<long>").alias("ns")).limit(0)
    g = corpus.where("label is not null").select("label", F.explode(T.grams(T.words(F.col("text")))).alias("gram"))
    ns = g.groupBy("gram").agg(*(F.count_if(F.col("label") == y).alias(f"n{k}") for k, y in enumerate(labels)))
    return labels, ns.select("gram", F.array(*(f"n{k}" for k in range(len(labels)))).alias("ns"))


def _ratios(corpus: DataFrame, alpha: float) -> tuple[list, DataFrame, list[Column], list[Column]]:
    """The labels, (gram, ns) stored, and by label the smoothed share p and ln(p / (1 - p)) as columns of it."""
    labels, ns = label_counts(corpus)
    if not labels:
        return labels, ns, [], []
    ns = checkpointed(ns)
    total = ns.agg(F.count("*").alias("v"), *(F.sum(F.col("ns")[k]).alias(f"s{k}") for k in range(len(labels)))).first()
    p = [(F.col("ns")[k] + alpha) / F.lit(float((total[f"s{k}"] or 0) + alpha * total["v"])) for k in range(len(labels))]
    return labels, ns, p, [F.log(x / (1 - x)) for x in p]


def label_ratios(corpus: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(label, gram, p, ratio): smoothed share of the gram in its label over the whole vocabulary, and ln(p / (1 - p))."""
    labels, ns, p, _ = _ratios(corpus, alpha)
    if not labels:
        return corpus.sparkSession.createDataFrame([], f"label {corpus.schema['label'].dataType.simpleString()}, gram string, p double, ratio double")
    each = F.array(*(F.struct(F.lit(y).alias("label"), p[k].alias("p")) for k, y in enumerate(labels)))
    p = ns.select("gram", F.explode(each).alias("x"))
    return p.select("x.label", "gram", "x.p", F.log(F.col("x.p") / (1 - F.col("x.p"))).alias("ratio"))


def gram_totals(corpus: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(doc_id, label, total, n_grams): for each document and label, the sum of the ratios of its grams' occurrences, and its
    distinct grams. A gram brings all labels' ratios in one row, frequent grams' ratios are broadcast, sums are
    pre-aggregated."""
    labels, ns, _, ratio = _ratios(corpus, alpha)
    if not labels:
        return corpus.sparkSession.createDataFrame([], corpus.select("doc_id", "label").schema.add("total", "double").add("n_grams", "long"))
    often = F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x)
    values = ns.select("gram", often.alias("often"), *(r.alias(f"r{k}") for k, r in enumerate(ratio)))
    g = looked_up(per_document(corpus, T.grams(T.words(F.col("text"))), "gram"), values, "gram", "often")
    s = g.groupBy("doc_id").agg(F.count("*").alias("n_grams"), *(F.sum(F.col("n") * F.col(f"r{k}")).alias(f"s{k}") for k in range(len(labels))))
    each = F.array(*(F.struct(F.lit(y).alias("label"), F.col(f"s{k}").alias("total")) for k, y in enumerate(labels)))
    return s.select("doc_id", F.inline(each), "n_grams")


def gram_features(corpus: DataFrame, ratios: DataFrame) -> DataFrame:
    """(doc_id, label, gram, value): each occurrence of a gram adds its ratio, for each label."""
    g = per_document(corpus, T.grams(T.words(F.col("text"))), "gram")
    return g.join(ratios, "gram").select("doc_id", "label", "gram", (F.col("n") * F.col("ratio")).alias("value"))
