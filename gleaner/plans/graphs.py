"""Graphs of hosts, paths, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import links as L
from ..session import table
from . import query
from .pages import _links_sql

# Suppliers point to the parts they sold, and parts that were returned to their suppliers. Weights are whole cents, so sums are exact.
_N = "n AS (SELECT 's' || s_suppkey AS nid, round(s_acctbal * 100) AS weight FROM supplier UNION ALL SELECT 'p' || p_partkey, round(p_retailprice * 100) FROM part)"
_E = "e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, sum(l_quantity) FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)"
_ALL = "al AS (SELECT DISTINCT nid FROM (SELECT nid FROM n UNION ALL SELECT src FROM e UNION ALL SELECT dst FROM e))"
_IN = "i AS (SELECT dst AS nid, coalesce(n.weight, 0) AS nw, e.weight AS ew, src FROM e LEFT JOIN n ON n.nid = e.src)"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("nid"), F.round(F.col("s_acctbal") * 100).alias("weight"))
    nodes = nodes.unionAll(table(spark, sf_dir, "part").select(name("p", "p_partkey").alias("nid"), F.round(F.col("p_retailprice") * 100).alias("weight")))
    sold = table(spark, sf_dir, "lineitem").select(name("s", "l_suppkey").alias("s"), name("p", "l_partkey").alias("p"), "l_quantity", "l_returnflag")
    total = lambda rows, a, b: rows.groupBy(F.col(a).alias("src"), F.col(b).alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    return nodes, total(sold, "s", "p").unionAll(total(sold.where("l_returnflag = 'R'"), "p", "s"))


def _r(df: DataFrame) -> DataFrame:
    return df.select("nid", *(F.round(c, 6).alias(c) for c in df.columns if c != "nid"))


def _sql(aggs: list[str]) -> str:
    outs = ", ".join(f"round(coalesce(f{k}, 0), 6) AS f{k}" for k in range(1, len(aggs) + 1))
    ins = ", ".join(f"{a} AS f{k}" for k, a in enumerate(aggs, 1))
    return f"WITH {_N}, {_E}, {_ALL}, {_IN}, f AS (SELECT nid, {ins} FROM i GROUP BY nid) SELECT al.nid, {outs} FROM al LEFT JOIN f ON al.nid = f.nid"


@query(_sql(["avg(nw)", "avg(ew)", "avg(nw * ew)"]))
def graph_avg_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(G.average(*graph(spark, sf_dir)))


@query(_sql(["sum(nw)", "sum(ew)", "sum(nw * ew)"]))
def graph_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(G.first_order(*graph(spark, sf_dir)))


@query(_sql(["sum(nw)", "sum(ew)"]))
def graph_iein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(G.in_edges(*graph(spark, sf_dir)))


@query(_sql(["greatest(0, max(nw))", "greatest(0, max(ew))", "greatest(0, max(nw * ew))"]))
def graph_max_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(G.greatest(*graph(spark, sf_dir)))


@query(f"WITH {_N}, {_E}, {_ALL}, {_IN}, f AS (SELECT nid, count(*) AS f1, sum(nw) AS f2, sum(ew) AS f3, sum(nw * ew) AS f4 FROM i GROUP BY nid), o AS (SELECT x.dst AS nid, sum(coalesce(n.weight, 0)) AS f5, sum(y.weight) AS f6, sum(coalesce(n.weight, 0) * y.weight) AS f7 FROM e x JOIN e y ON x.src = y.src LEFT JOIN n ON n.nid = y.dst GROUP BY x.dst) SELECT al.nid, coalesce(f1, 0)::DOUBLE AS f1, round(coalesce(f2, 0), 2) AS f2, round(coalesce(f3, 0), 2) AS f3, round(coalesce(f4, 0), 2) AS f4, round(coalesce(f5, 0), 2) AS f5, round(coalesce(f6, 0), 2) AS f6, round(coalesce(f7, 0), 2) AS f7 FROM al LEFT JOIN f ON al.nid = f.nid LEFT JOIN o ON al.nid = o.nid")
def graph_second_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = G.second_level(*graph(spark, sf_dir))
    return f.select("nid", "f1", *(F.round(c, 2).alias(c) for c in ("f2", "f3", "f4", "f5", "f6", "f7")))


@query(f"WITH {_N}, {_E}, {_ALL} SELECT al.nid, coalesce(weight, 0) AS weight FROM al LEFT JOIN n ON al.nid = n.nid")
def oracle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.all_nodes(*graph(spark, sf_dir))


@query(f"WITH {_N}, {_E}, u AS (SELECT nid, weight, 0 AS s FROM n UNION ALL SELECT src, max(weight), 1 FROM e GROUP BY src) SELECT nid, arg_max(weight, s) AS newest, arg_min(weight, s) AS oldest FROM u GROUP BY nid")
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    new = e.groupBy(F.col("src").alias("nid")).agg(F.max("weight").alias("weight"))
    return G.put_nodes(n, new).withColumnRenamed("weight", "newest").join(G.put_nodes(n, new, False).withColumnRenamed("weight", "oldest"), "nid")


@query(f"WITH {_E} SELECT dst AS nid, array_to_string(list_sort(list(DISTINCT src)), ',') AS near FROM e GROUP BY dst")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(graph(spark, sf_dir)[1]).select("nid", F.array_join("near", ",").alias("near"))


@query(f"WITH {_E}, u AS (SELECT src, dst, weight, 0 AS s FROM e UNION ALL SELECT dst, src, weight * 2, 1 FROM e) SELECT src, dst, arg_max(weight, s) AS weight FROM u GROUP BY src, dst")
def graph_edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge turned round with twice its weight, over those that are there."""
    e = graph(spark, sf_dir)[1]
    return G.put_edges(e, e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * 2).alias("weight")))


@query(_sql(["sum(nw)", "sum(ew)", "sum(nw * ew)"]).replace("round(coalesce(f1, 0), 6)", "round(ln(1 + greatest(coalesce(f1, 0), -0.5)), 9)").replace("round(coalesce(f2, 0), 6)", "round(ln(1 + coalesce(f2, 0)), 9)").replace("round(coalesce(f3, 0), 6)", "round(ln(1 + greatest(coalesce(f3, 0), -0.5)), 9)"))
def graph_first_order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ln(1 + x) of the sums; negative balances count as none beyond a half."""
    nodes, edges = graph(spark, sf_dir)
    f = G.first_order(nodes, edges)
    return f.select("nid", *(F.round(F.log1p(F.greatest(F.col(c), F.lit(-0.5)) if c != "f2" else F.col(c)), 9).alias(c) for c in ("f1", "f2", "f3")))


@query(f"WITH RECURSIVE {_links_sql()}, ed AS (SELECT DISTINCT base AS src, url AS dst FROM links), rr AS (SELECT (SELECT url FROM pages ORDER BY page_id LIMIT 1) AS nid, 0 AS depth UNION SELECT ed.dst, rr.depth + 1 FROM rr JOIN ed ON rr.nid = ed.src WHERE rr.depth < 4) SELECT nid, min(depth) AS depth FROM rr GROUP BY nid")
def bfs_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that the first page leads to within four links."""
    pages = table(spark, sf_dir, "pages")
    edges = L.extract(pages).select(F.col("parent_url").alias("src"), F.col("url").alias("dst")).distinct()
    return G.reach(edges, pages.orderBy("page_id").limit(1).select(F.col("url").alias("nid")), 4)


@query(f"WITH RECURSIVE {_N}, {_E}, sd AS (SELECT nid FROM n ORDER BY nid LIMIT 2), rr AS (SELECT nid, 1 AS step FROM sd UNION SELECT e.dst, rr.step + 1 FROM rr JOIN e ON rr.nid = e.src WHERE rr.step < 4), st AS (SELECT nid, min(step) AS step FROM rr GROUP BY nid), w AS (SELECT st.nid, step, coalesce(weight, 0) AS weight FROM st LEFT JOIN n ON st.nid = n.nid) SELECT step, nid, round(weight, 4) AS weight, round(sum(weight) OVER (ORDER BY step), 2) AS total FROM w")
def bfs_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four steps of a crawl that takes its whole frontier each time."""
    n, e = graph(spark, sf_dir)
    c = G.crawl(n, G.checkpointed(e), n.orderBy("nid").limit(2), steps=4, batch=None, score="bfs")
    return c.select("step", "nid", F.round("weight", 4).alias("weight"), F.round("total", 2).alias("total"))


@query()
def crawl_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return G.crawl(n, G.checkpointed(e), n.orderBy("nid").limit(2), steps=4, batch=5, score="relevance")


@query()
def regression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return G.regression_scores(n, e)


@query(f"WITH {_N}, {_E}, {_ALL} SELECT al.nid, coalesce(weight, 0) AS weight FROM al LEFT JOIN n ON al.nid = n.nid")
def graph_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as lines of nodes and edges, written and read; what has no weight of its own weighs 0."""
    from ..sources.files import read_graph

    n, e = graph(spark, sf_dir)
    lines = n.select(F.concat_ws("\t", "nid", F.col("weight").cast("string")).alias("value")).unionAll(e.select(F.concat_ws("\t", "src", "dst", F.col("weight").cast("string")).alias("value")))
    return G.all_nodes(*read_graph(G.checkpointed(lines)))


@query("SELECT o_orderkey AS line, unnest(['o' || o_orderkey, 'c' || o_custkey]) AS nid FROM orders")
def seed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each order: its own id and its customer's, with blanks around."""
    from ..sources.files import read_seeds

    o = table(spark, sf_dir, "orders")
    return read_seeds(o.select(F.col("o_orderkey").alias("line"), F.concat(F.lit(" o"), F.col("o_orderkey").cast("string"), F.lit("   c"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("value")))


@query("SELECT doc_id, lang AS label, md5(trim(regexp_replace(text, '[\t\r\n]+', ' ', 'g'))) AS digest FROM documents")
def corpus_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tab-separated lines, written and read back; the id leads the text."""
    from ..sources.files import corpus_round_trip

    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("label"), F.concat_ws(" ", F.col("doc_id").cast("string"), "text").alias("text"))
    c = corpus_round_trip(d)
    return c.select(F.split("text", " ", 2)[0].cast("long").alias("doc_id"), "label", F.md5(F.trim(F.split("text", " ", 2)[1]).cast("binary")).alias("digest"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def sql_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query in SQL over tables given by name."""
    return spark.sql("SELECT r_name, count(*) AS n FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name", nation=table(spark, sf_dir, "nation"), region=table(spark, sf_dir, "region"))
