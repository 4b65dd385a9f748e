"""Weighted directed graphs: nodes (nid, weight), edges (src, dst, weight); features, scores, crawl simulation."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put_nodes(nodes: DataFrame, new: DataFrame, overwrite: bool = True) -> DataFrame:
    """Nodes with further ones; of two weights the new one holds, or the old one if told so."""
    both = nodes.withColumn("s", F.lit(0)).unionByName(new.withColumn("s", F.lit(1)))
    return both.groupBy("nid").agg((F.max_by if overwrite else F.min_by)("weight", "s").alias("weight"))


def put_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    both = edges.withColumn("s", F.lit(0)).unionByName(new.withColumn("s", F.lit(1)))
    return both.groupBy("src", "dst").agg(F.max_by("weight", "s").alias("weight"))


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nid, weight) of nodes and of ends of edges; weight 0 where none is known."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("nid")).distinct()
    return ends.join(nodes, "nid", "full").select("nid", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def neighbours(edges: DataFrame, inward: bool = True) -> DataFrame:
    a, b = ("dst", "src") if inward else ("src", "dst")
    return edges.groupBy(F.col(a).alias("nid")).agg(F.array_sort(F.collect_set(b)).alias("near"))


def _in(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nid, nw, ew) for each edge into nid: its source's weight and its own."""
    n = nodes.select(F.col("nid").alias("src"), F.col("weight").alias("nw"))
    return edges.join(n, "src", "left").select(F.col("dst").alias("nid"), F.coalesce("nw", F.lit(0.0)).alias("nw"), F.col("weight").alias("ew"), "src")


def _complete(features: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without edges inward get zeros."""
    cols = [c for c in features.columns if c != "nid"]
    return all_nodes(nodes, edges).select("nid").join(features, "nid", "left").select("nid", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in cols))


def average(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    f = _in(nodes, edges).groupBy("nid").agg(F.avg("nw").alias("f1"), F.avg("ew").alias("f2"), F.avg(F.col("nw") * F.col("ew")).alias("f3"))
    return _complete(f, nodes, edges)


def first_order(nodes: DataFrame, edges: DataFrame, log: bool = False) -> DataFrame:
    f = _in(nodes, edges).groupBy("nid").agg(F.sum("nw").alias("f1"), F.sum("ew").alias("f2"), F.sum(F.col("nw") * F.col("ew")).alias("f3"))
    f = _complete(f, nodes, edges)
    return f.select("nid", *(F.log1p(c).alias(c) for c in ("f1", "f2", "f3"))) if log else f


def second_level(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Over in-neighbours: their number, sums of node, edge and product; over all that these point to (the node itself too):
    sums of node, edge and product. What a neighbour's own edges sum up to is aggregated before it is joined, so a hub
    costs one row for each of its edges and none for its pairs."""
    first = _in(nodes, edges).groupBy("nid").agg(F.count("*").cast("double").alias("f1"), F.sum("nw").alias("f2"), F.sum("ew").alias("f3"), F.sum(F.col("nw") * F.col("ew")).alias("f4"))
    n = nodes.select(F.col("nid").alias("dst"), F.col("weight").alias("nw"))
    out = edges.join(n, "dst", "left").withColumn("nw", F.coalesce("nw", F.lit(0.0)))
    out = out.groupBy("src").agg(F.sum("nw").alias("a"), F.sum("weight").alias("b"), F.sum(F.col("nw") * F.col("weight")).alias("c"))
    second = edges.join(out, "src").groupBy(F.col("dst").alias("nid")).agg(F.sum("a").alias("f5"), F.sum("b").alias("f6"), F.sum("c").alias("f7"))
    return _complete(first.join(second, "nid"), nodes, edges)


def in_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _complete(_in(nodes, edges).groupBy("nid").agg(F.sum("nw").alias("f1"), F.sum("ew").alias("f2")), nodes, edges)


def greatest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    top = lambda c: F.greatest(F.lit(0.0), F.max(c))
    f = _in(nodes, edges).groupBy("nid").agg(top("nw").alias("f1"), top("ew").alias("f2"), top(F.col("nw") * F.col("ew")).alias("f3"))
    return _complete(f, nodes, edges)


FEATURES = {"average": average, "first_order": first_order, "second_level": second_level, "in_edges": in_edges, "greatest": greatest}


def regression_scores(nodes: DataFrame, edges: DataFrame, features: str = "first_order", log: bool = False) -> DataFrame:
    """(nid, score): linear regression of the node weights on features; in log space, of rows with positive features only."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    f = FEATURES[features](nodes, edges)
    cols = [c for c in f.columns if c != "nid"]
    train = f.join(nodes, "nid")
    if log:
        train = train.where(" AND ".join(f"{c} > 0" for c in cols) + " AND weight > 0").select("nid", F.log("weight").alias("weight"), *(F.log(c).alias(c) for c in cols))
        f = f.select("nid", *(F.log(F.greatest(F.col(c), F.lit(1e-9))).alias(c) for c in cols))
    v = VectorAssembler(inputCols=cols, outputCol="features")
    m = LinearRegression(labelCol="weight", regParam=1e-6).fit(v.transform(train))
    s = m.transform(v.transform(f)).select("nid", F.col("prediction").alias("score"))
    return s.withColumn("score", F.exp("score")) if log else s


def reach(edges: DataFrame, seeds: DataFrame, steps: int, stored=None) -> DataFrame:
    """(nid, depth): what seeds (nid) lead to within so many steps, and how soon. Each round joins the newest nodes only and
    is cut off from the last by a table or checkpoint."""
    keep = stored or checkpointed
    found = keep(seeds.select("nid").distinct().withColumn("depth", F.lit(0)))
    front = found
    for k in range(1, steps + 1):
        new = edges.join(front.select(F.col("nid").alias("src")), "src").select(F.col("dst").alias("nid")).distinct()
        front = keep(new.join(found, "nid", "left_anti").withColumn("depth", F.lit(k)))
        if front.isEmpty():
            break
        found = keep(found.unionByName(front))
    return found


_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in one of the application's own where it names none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        import tempfile

        at = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="gleaner-")
        _OWN[spark.sparkContext.applicationId] = at
    return f"{at}/gleaner-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. spent() removes them all."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spent(spark: SparkSession) -> None:
    """Removes what this application has stored in the shared folder, when no result that reads it is needed any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "x").rsplit("/", 1)[0])
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def crawl(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, steps: int, batch: int | None = 1, score: str | Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = "oracle", epsilon: float = 0.0, seed: int = 1) -> DataFrame:
    """(step, nid, weight, total): a simulated crawl. Each step takes the `batch` best nodes of the frontier (None: all), reveals their
    weights and adds what they point to. Scores: 'oracle' (true weight), 'bfs' (sooner found first), 'relevance' (sum of
    revealed in-neighbours' weights), or a function of the frontier (nid, found, weight, which it must not look at), of
    what was taken (nid, step, weight) and the edges that adds the column score; with probability epsilon a step takes any nodes instead. Ties go to the smaller id."""
    every = all_nodes(nodes, edges)
    front = checkpointed(seeds.select("nid").distinct().withColumn("found", F.lit(0)))
    done = checkpointed(front.limit(0).select("nid", F.lit(0).alias("step"), F.lit(0.0).alias("weight")))
    for k in range(1, steps + 1):
        c = front.join(every, "nid", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        if callable(score):
            c = score(c, done, edges)
        elif score == "oracle":
            c = c.withColumn("score", F.col("weight"))
        elif score == "bfs":
            c = c.withColumn("score", -F.col("found").cast("double"))
        else:
            seen = edges.join(done.select(F.col("nid").alias("src"), F.col("weight").alias("w")), "src").groupBy(F.col("dst").alias("nid")).agg(F.sum("w").alias("score"))
            c = c.join(seen, "nid", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        explore = (F.pmod(F.xxhash64(F.lit(seed), F.lit(k)), F.lit(10_000)) / 10_000) < epsilon
        c = c.withColumn("key", F.when(explore, F.xxhash64(F.lit(seed), F.lit(k), "nid").cast("double")).otherwise(F.col("score")))
        best = c if batch is None else c.orderBy(F.col("key").desc(), "nid").limit(batch)
        picked = checkpointed(best.select("nid", F.lit(k).alias("step"), "weight"))
        if picked.isEmpty():
            break
        done = checkpointed(done.unionByName(picked))
        new = edges.join(picked.select(F.col("nid").alias("src")), "src").select(F.col("dst").alias("nid")).distinct().withColumn("found", F.lit(k))
        front = checkpointed(front.unionByName(new).groupBy("nid").agg(F.min("found").alias("found")).join(done.select("nid"), "nid", "left_anti"))
    total = done.groupBy("step").agg(F.sum("weight").alias("w"))
    upto = total.alias("a").join(total.alias("b"), F.col("b.step") <= F.col("a.step")).groupBy(F.col("a.step").alias("step")).agg(F.sum("b.w").alias("total"))
    return done.join(upto, "step").select("step", "nid", "weight", "total")


def raced(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, steps: int, scores: dict, batch: int | None = 1, **options) -> DataFrame:
    """(name, seconds, step, nid, weight, total): the same crawl under several ways of scoring, each with what it took."""
    out = None
    for name, score in scores.items():
        start = time.perf_counter()
        c = checkpointed(crawl(nodes, edges, seeds, steps, batch, score, **options))
        c = c.select(F.lit(name).alias("name"), F.lit(time.perf_counter() - start).alias("seconds"), "step", "nid", "weight", "total")
        out = c if out is None else out.unionByName(c)
    return out
