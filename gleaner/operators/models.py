"""Classifiers over Spark ML, and recursive least squares."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.clustering import LDA
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, HashingTF, NGram, Normalizer, UnivariateFeatureSelector
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import checkpointed

METHODS = {"logistic": lambda: LogisticRegression(maxIter=20, regParam=0.01), "logistic_l1": lambda: LogisticRegression(maxIter=20, regParam=0.01, elasticNetParam=1.0), "svc": lambda: LinearSVC(maxIter=20, regParam=0.01)}
#: No vocabulary is cut: CountVectorizer counts the terms of two or more documents and takes them all.
ALL = (1 << 31) - 1
TOKENIZERS = {"words": T.words, "grams": lambda c: T.grams(T.words(c)), "blanks": lambda c: F.split(c, " ")}


def with_tokens(df: DataFrame, text: str = "text", tokenizer: str | None = "words", custom=None) -> DataFrame:
    return df.withColumn("tokens", (custom or TOKENIZERS[tokenizer])(F.coalesce(F.col(text), F.lit(""))))


def binary(ratio: float = 0.4, vocabulary: int = ALL, method: str = "logistic", estimator=None, select: bool = True, converter: list | None = None) -> Pipeline:
    """tokens -> counts -> the share `ratio` of the terms by chi-square -> idf -> a linear model of column label. A converter, stages
    that make `counts` of `tokens`, takes the place of the vocabulary."""
    stages = list(converter or [CountVectorizer(inputCol="tokens", outputCol="counts", vocabSize=vocabulary, minDF=2)])
    last = "counts"
    if select:
        pick = UnivariateFeatureSelector(featuresCol="counts", outputCol="picked", labelCol="label", selectionMode="percentile").setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(ratio)
        stages.append(pick)
        last = "picked"
    stages += [IDF(inputCol=last, outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="features"), estimator or METHODS[method]()]
    return Pipeline(stages=stages)


def hashed(features: int = 1 << 16, method: str = "logistic", n: int = 2) -> Pipeline:
    """As binary, by hashing: no vocabulary, so nothing that grows with the corpus is held."""
    return Pipeline(stages=[NGram(n=n, inputCol="tokens", outputCol="pairs"), HashingTF(inputCol="tokens", outputCol="counts", numFeatures=features), IDF(inputCol="counts", outputCol="features"), METHODS[method]()])


def many(method: str = "svc", features: int = 1 << 14) -> Pipeline:
    """One against the rest over hashed words; column label numeric."""
    return Pipeline(stages=[HashingTF(inputCol="tokens", outputCol="features", numFeatures=features), OneVsRest(classifier=METHODS[method]())])


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with prediction and prob, the probability of what is predicted (of a margin m, 1 / (1 + e^-|m|))."""
    out = model.transform(df)
    p = F.array_max(vector_to_array("probability")) if "probability" in out.columns else 1 / (1 + F.exp(-F.abs(F.element_at(vector_to_array("rawPrediction"), 2))))
    return out.withColumn("prob", p)


def cross_validated(pipeline: Pipeline, df: DataFrame, folds: int = 3, seed: int = 1) -> float:
    """Mean area under the ROC curve over the folds. What leading stages make without fitting is made once and stored."""
    rest, df = prepared(pipeline, df)
    return validated(rest, df, folds, seed)


def prepared(pipeline: Pipeline, df: DataFrame) -> tuple[Pipeline, DataFrame]:
    """The stages from the first that is fitted on, and a stored table of column label and the vectors that the stages before it make
    (of all columns, where there are none)."""
    stages = list(pipeline.getStages())
    fitted = next((k for k, s in enumerate(stages) if not isinstance(s, Transformer)), len(stages))
    for s in stages[:fitted]:
        df = s.transform(df)
    if fitted:
        df = df.select("label", *(f.name for f in df.schema if isinstance(f.dataType, VectorUDT)))
    return Pipeline(stages=stages[fitted:]), checkpointed(df)


def validated(pipeline: Pipeline, df: DataFrame, folds: int = 3, seed: int = 1) -> float:
    """cross_validated() of a table that is stored already."""
    check = CrossValidator(estimator=pipeline, estimatorParamMaps=[{}], evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=seed)
    return check.fit(df).avgMetrics[0]


def reported(pipeline: Pipeline, train: DataFrame, test: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """A model fitted on train, and (label, precision, recall) in percent of what it predicts of test; column label on both."""
    from . import evaluate as E

    m = pipeline.fit(train)
    p = m.transform(test).select(F.col("label").cast("double").alias("truth"), F.col("prediction").alias("predicted"))
    return m, E.report(E.by_label(p))


class Bundle:
    """Models by name (of URLs, anchors, paragraphs, ..) that are kept together: name -> (model, column of the text)."""

    def __init__(self, models: dict[str, tuple[PipelineModel, str]]):
        self.models = models

    def save(self, spark: SparkSession, path: str) -> None:
        for name, (m, _) in self.models.items():
            m.write().overwrite().save(f"{path}/{name}")
        spark.createDataFrame([(n, c) for n, (_, c) in self.models.items()], "name string, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        return cls({r["name"]: (PipelineModel.load(f"{path}/{r['name']}"), r["text"]) for r in spark.read.parquet(f"{path}/names").collect()})

    def predict(self, df: DataFrame, **rules: Column) -> DataFrame:
        """df with a struct (label, prob) for each model, under its name: what its rule says, where it says anything, else
        what the model predicts, labels as '0' and '1'."""
        for name, (m, text) in self.models.items():
            had = df.columns
            out = scored(m, with_tokens(df, text))
            vote = F.struct(F.col("prediction").cast("int").cast("string").alias("label"), "prob")
            df = out.select(*had, F.coalesce(rules[name], vote).alias(name) if name in rules else vote.alias(name))
        return df


def json_map(df: DataFrame, key: str, label: str = "prediction", prob: str = "prob") -> DataFrame:
    """(value): for each row, key: [label, probability] as JSON, a line each; the lines of all rows are the map."""
    return df.select(F.to_json(F.create_map(F.col(key).cast("string"), F.array(F.col(label).cast("int").cast("string"), F.format_string("%.6f", prob)))).alias("value"))


class PerClass:
    """One against the rest, each class with its own gram ratios as weights: one vector of hashed gram counts for a
    document, and for each class its ratios by feature (scaled in the JVM) and a linear model; the classes are few, so
    all stand in one pipeline that reads a document once."""

    def __init__(self, model: PipelineModel, labels: list[str]):
        self.model, self.labels = model, labels

    @staticmethod
    def _tokens(corpus: DataFrame) -> DataFrame:
        return corpus.withColumn("grams", T.grams(T.words(F.col("text"))))

    @classmethod
    def train(cls, corpus: DataFrame, size: int = 1 << 18, alpha: float = 1.0) -> PerClass:
        """corpus (doc_id, label, text). Ratios are those of term statistics with hashed grams for grams: ln(p / (1 - p)) of the
        feature's smoothed share in the class, 0 for features that the corpus lacks. `size` numbers a class are held by the driver."""
        tf = HashingTF(inputCol="grams", outputCol="counts", numFeatures=size)
        v = checkpointed(tf.transform(cls._tokens(corpus.where("label is not null"))).select("label", "counts"))
        sums = {r["label"]: r["s"].toArray() for r in v.groupBy("label").agg(Summarizer.sum(F.col("counts")).alias("s")).collect()}
        labels = sorted(sums)
        seen = sum(sums.values(), np.zeros(size)) > 0
        stages = [tf]
        for k, y in enumerate(labels):
            p = (sums[y] + alpha) / (sums[y].sum() + alpha * max(1, seen.sum()))
            with np.errstate(divide="ignore"):
                ratio = np.where(seen, np.log(p) - np.log1p(-np.minimum(p, 1 - 1e-12)), 0.0)
            scale = ElementwiseProduct(scalingVec=Vectors.dense(ratio), inputCol="counts", outputCol=f"x{k}")
            fit = LogisticRegression(maxIter=10, regParam=0.1, featuresCol=f"x{k}", labelCol="y", rawPredictionCol=f"raw{k}", probabilityCol=f"prob{k}", predictionCol=f"is{k}")
            stages += [scale, fit.fit(scale.transform(v.withColumn("y", (F.col("label") == y).cast("double"))))]
        return cls(PipelineModel(stages), labels)

    def predict(self, corpus: DataFrame) -> DataFrame:
        """(doc_id, label, prob): the class of the highest decision value, the first on a tie, and its probability."""
        out = self.model.transform(self._tokens(corpus.select("doc_id", "text")))
        each = F.array(*(F.struct((-vector_to_array(f"raw{k}")[1]).alias("r"), F.lit(y).alias("label"), vector_to_array(f"prob{k}")[1].alias("prob")) for k, y in enumerate(self.labels)))
        return out.select("doc_id", F.array_min(each).alias("b")).select("doc_id", "b.label", "b.prob")

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(k, y) for k, y in enumerate(self.labels)], "k int, label string").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PerClass:
        return cls(PipelineModel.load(f"{path}/model"), [r["label"] for r in spark.read.parquet(f"{path}/labels").orderBy("k").collect()])


def topics(df: DataFrame, k: int = 20, iterations: int = 50, words: int = 10, seed: int = 1) -> DataFrame:
    """(topic, rank, term, weight) of tokens."""
    v = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=ALL, minDF=2).fit(df)
    t = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online").fit(v.transform(df)).describeTopics(words)
    vocab = F.array(*map(F.lit, v.vocabulary))
    return t.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "x")).select("topic", "rank", F.get(vocab, F.col("x.termIndices")).alias("term"), F.col("x.termWeights").alias("weight"))


def cotrain(df: DataFrame, rounds: int = 30, pool: int = 75, positive: int = 1, negative: int = 1, checkpoint=None, seed: int = 1, estimators: tuple | None = None) -> tuple:
    """Two-view training on df (id, x1, x2 vectors, label 1, 0 or -1 for unknown) -> the two models.

    Each round fits a model per view, scores a pool of unknown rows, and labels at most `positive` and `negative` of those
    on which both agree, the surest by the sum of their probabilities; the pool is refilled. Estimators of the two views
    may be given: of columns x1 and x2, with probabilities."""
    keep = checkpoint or checkpointed
    known, rest = keep(df.where("label >= 0")), keep(df.where("label < 0"))
    views = estimators or tuple(LogisticRegression(featuresCol=x, labelCol="label", maxIter=10, regParam=0.01) for x in ("x1", "x2"))
    fit = lambda: [e.fit(known) for e in views]
    for _ in range(rounds):
        m = fit()
        few = rest.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(pool)
        s = few
        for k in (0, 1):
            s = m[k].transform(s).withColumn(f"p{k}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
        sum_ = F.col("p0") + F.col("p1")
        yes = s.where("p0 >= 0.5 and p1 >= 0.5").orderBy(sum_.desc(), "id").limit(positive).withColumn("label", F.lit(1))
        no = s.where("p0 < 0.5 and p1 < 0.5").orderBy(sum_.asc(), "id").limit(negative).withColumn("label", F.lit(0))
        new = keep(yes.unionByName(no).select(*df.columns))
        if new.isEmpty():
            break
        known, rest = keep(known.unionByName(new)), keep(rest.join(new.select("id"), "id", "left_anti"))
    return tuple(fit())


def rls_step(w: np.ndarray, p: np.ndarray, x: np.ndarray, y: float, forget: float = 0.99) -> tuple[np.ndarray, np.ndarray]:
    k = p @ x / (forget + x @ p @ x)
    return w + k * (y - x @ w), (p - np.outer(k, x @ p)) / forget


def rls(df: DataFrame, key: str, order: str, x: list[str], y: str, forget: float = 0.99, start: float = 1e-4) -> DataFrame:
    """(key, n, w array<double>): recursive least squares over each key's rows in order, of 1 and the columns x. Rows come
    sorted, a batch at a time, so no task holds a key's rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        now, n, w, cov = None, 0, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], b.schema[0].type), pa.array([n], pa.int64()), pa.array([w.tolist()], pa.list_(pa.float64()))], [key, "n", "w"])
        for b in batches:
            a = np.column_stack([np.ones(b.num_rows), *(c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns[2:-1])])
            ys = b.column(b.num_columns - 1).cast(pa.float64()).to_numpy(zero_copy_only=False)
            for k, row, v in zip(b.column(0).to_pylist(), a, ys):
                if not n or k != now and (k == k or now == now):
                    if n:
                        yield done()
                    now, n, w, cov = k, 0, np.zeros(a.shape[1]), np.eye(a.shape[1]) / start
                n += 1
                if np.isfinite(v) and np.isfinite(row).all():
                    w, cov = rls_step(w, cov, row, v, forget)
        if n:
            yield done()

    rows = df.select(F.col(key), F.col(order), *x, y).repartition(key).sortWithinPartitions(key, F.col(order).asc_nulls_last(), *x, y)
    return rows.mapInArrow(run, f"`{key}` {kind}, n long, w array<double>")


def agreement(a: Column, b: Column) -> Column:
    return (a + b) / 2
