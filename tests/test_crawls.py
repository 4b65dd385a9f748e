"""Frontier, graphs, simulated crawls, recursive least squares, files and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import frontier as P
from gleaner.operators import graph as G
from gleaner.operators import models as K
from gleaner.sources import files as S
from gleaner.streaming import replay as R

NODES = [("1", 0.5), ("2", 0.25), ("3", 1.0), ("4", 0.0), ("5", 2.0)]
EDGES = [("1", "2", 1.0), ("1", "3", 0.5), ("2", "3", 2.0), ("3", "4", 1.0), ("4", "1", 1.0), ("3", "5", 3.0)]


@pytest.fixture
def graph(spark):
    return spark.createDataFrame(NODES, "nid string, weight double"), spark.createDataFrame(EDGES, "src string, dst string, weight double")


def features(df):
    return {r["nid"]: tuple(round(x, 9) for x in r[1:]) for r in df.collect()}


def test_features(graph):
    nodes, edges = graph
    assert features(G.average(nodes, edges))["3"] == (0.375, 1.25, 0.375)
    assert features(G.first_order(nodes, edges))["3"] == (0.75, 2.5, 0.75)
    assert features(G.in_edges(nodes, edges))["3"] == (0.75, 2.5)
    assert features(G.greatest(nodes, edges))["3"] == (0.5, 2.0, 0.5)
    w, out = dict(NODES), {}
    for s, d, e in EDGES:
        out.setdefault(s, []).append((d, e))
    for n, got in features(G.second_level(nodes, edges)).items():
        parents = [(s, e) for s, d, e in EDGES if d == n]
        kids = [(d, e) for s, _ in parents for d, e in out[s]]
        want = (len(parents), sum(w[s] for s, _ in parents), sum(e for _, e in parents), sum(w[s] * e for s, e in parents), sum(w[d] for d, _ in kids), sum(e for _, e in kids), sum(w[d] * e for d, e in kids))
        assert got == tuple(round(x, 9) for x in want)


def test_updates_and_reach(spark, graph):
    nodes, edges = graph
    new = spark.createDataFrame([("1", 9.0), ("6", 1.0)], nodes.schema)
    assert {r[0]: r[1] for r in G.put_nodes(nodes, new).collect()}["1"] == 9 and {r[0]: r[1] for r in G.put_nodes(nodes, new, overwrite=False).collect()}["1"] == 0.5
    assert {tuple(r) for r in G.reach(edges, spark.createDataFrame([("2",)], "nid string"), 9).collect()} == {("2", 0), ("3", 1), ("4", 2), ("5", 2), ("1", 3)}
    assert {tuple(r) for r in G.reach(edges, spark.createDataFrame([("2",)], "nid string"), 1).collect()} == {("2", 0), ("3", 1)}


def test_crawls(spark, graph):
    nodes, edges = graph
    seed = spark.createDataFrame([("1",)], "nid string")
    order = lambda **k: [(r["nid"], r["total"]) for r in G.crawl(nodes, edges, seed, 5, **k).orderBy("step", "nid").collect()]
    assert order() == [("1", 0.5), ("3", 1.5), ("5", 3.5), ("2", 3.75), ("4", 3.75)]
    assert [n for n, _ in order(score="bfs")] == ["1", "2", "3", "4", "5"]
    assert len(order(score="relevance")) == 5 and sorted(n for n, _ in order(epsilon=1.0)) == ["1", "2", "3", "4", "5"]


def test_own_scores_and_races(spark, graph):
    nodes, edges = graph
    seed = spark.createDataFrame([("1",)], "nid string")
    by_name = lambda front, done, edges: front.withColumn("score", F.col("nid").cast("double"))
    assert [r["nid"] for r in G.crawl(nodes, edges, seed, 4, score=by_name).orderBy("step").collect()] == ["1", "3", "5", "4"]
    r = G.raced(nodes, edges, seed, 3, {"all": "bfs", "own": by_name}, batch=None).collect()
    assert {(x["name"], x["step"], x["nid"]) for x in r} == {(n, *x) for n in ("all", "own") for x in ((1, "1"), (2, "2"), (2, "3"), (3, "4"), (3, "5"))}
    assert all(x["seconds"] > 0 for x in r)


def test_encodings_in_turn(spark):
    rows = [(1, "中".encode(), None), (2, "中".encode(), "latin-1"), (3, "中".encode("gbk"), None), (4, "é".encode("latin-1"), "ascii"), (5, b"\xff\xff\xff", None), (6, None, "utf-8"), (7, "é".encode(), "no such"), (8, b"ok", "UTF-8")]
    df = spark.createDataFrame(rows, "k int, raw binary, name string")
    got = [r["t"] for r in df.select("k", S.decode(F.col("raw"), F.col("name")).alias("t")).orderBy("k").collect()]
    assert got == ["中", "中".encode().decode("latin-1"), "中", None, None, None, "é", "ok"]
    assert df.select(S.decode(F.col("raw")).alias("t")).where("t = '中'").count() == 3


def test_lines(spark, tmp_path):
    S.write_lines(spark.range(3), str(tmp_path / "l"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["0", "1", "2"]


def test_spent_tables_go(spark):
    import os

    at = G.shared_path(spark, "x").removeprefix("file:").rsplit("/", 1)[0].replace("//", "/")
    G.checkpointed(spark.range(3))
    assert os.listdir(at)
    G.spent(spark)
    assert not os.path.exists(at)


def test_frontier(spark):
    rows = [("a", "p", 0.4, "0", 0.85), ("b", "p", 0.2, "0", 0.6), ("b", "q", 0.6, "0", 0.55), ("c", "p", 1.0, "0", 0.4), ("d", "p", 1.0, "1", 0.9), ("a", "p", 0.1, "0", 0.5)]
    f = P.levels(P.upsert(spark.createDataFrame(rows, "url string, parent_url string, node_weight double, label string, prob double")))
    assert {r["url"]: (r["level"], round(r["priority"], 9)) for r in f.collect()} == {"a": (0, round(0.25 * 0.4 + 0.75 * 0.85, 9)), "b": (1, round(0.25 * 0.4 + 0.75 * 0.6, 9))}
    assert [(r["url"], r["request"]) for r in P.next_urls(f, 9).collect()] == [("a", 737.5), ("b", 550.0)]


def test_rls(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = 3 + x @ np.array([2.0, -1.0])
    df = spark.createDataFrame([("k", i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))] + [("k", 999, None, 1.0, 1.0)], "k string, i int, a double, b double, y double")
    r = K.rls(df, "k", "i", ["a", "b"], "y").first()
    assert np.allclose(r["w"], [3, 2, -1], atol=1e-3) and r["n"] == 401


def test_page_files(spark, tmp_path):
    (tmp_path / "7.html").write_bytes("http://h/中\n<p>中文".encode())
    (tmp_path / "12.html").write_bytes("http://g/\n<p>中文\nx".encode("gbk"))
    (tmp_path / "no.html").write_bytes(b"http://only")
    rows = {r["number"]: (r["url"], r["html"]) for r in S.read_pages(spark, str(tmp_path)).collect()}
    assert rows == {7: ("http://h/中", "<p>中文"), 12: ("http://g/", "<p>中文\nx"), None: ("http://only", "")}
    done = S.read_pages(spark, str(tmp_path)).where("number = 7")
    assert S.read_pages(spark, str(tmp_path), done).count() == 2
    S.write_pages(spark.createDataFrame([("u", "a\nb\n"), ("v", "")], "url string, html string"), str(tmp_path / "packed"))
    assert sorted(tuple(r) for r in S.read_packed_pages(spark, str(tmp_path / "packed")).collect()) == [("u", "a\nb\n"), ("v", "")]


def test_other_files(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    S.write_corpus(spark.createDataFrame([("0", "a\tb\nc"), ("1", None)], "label string, text string"), at("c"))
    assert sorted(tuple(r) for r in S.read_corpus(spark, at("c")).collect()) == [("0", "a b c"), ("1", "")]
    (tmp_path / "t.tsv").write_text("only\n0\tx\ty\n\n")
    assert [tuple(r) for r in S.read_corpus(spark, at("t.tsv")).collect()] == [("0", "x\ty")]
    S.write_documents(spark.createDataFrame([("t", None, "u", 'd"')], S.DOCUMENT), at("d"))
    assert [tuple(r) for r in S.read_documents(spark, at("d")).collect()] == [("t", None, "u", 'd"')]
    (tmp_path / "words").write_text(" a \n\nb\na\n")
    assert sorted(r[0] for r in S.read_dictionary(spark, at("words")).collect()) == ["a", "b"]
    S.write_libsvm(spark.createDataFrame([(1, 0, 3, 0.5), (1, 0, 1, 2.0), (2, 1, 2, 1.0)], "doc_id int, label int, id int, value double"), at("s"))
    assert sorted((r["label"], r["features"].toArray().tolist()) for r in S.read_libsvm(spark, at("s"), 3).collect()) == [(0.0, [2.0, 0.0, 0.5]), (1.0, [0.0, 1.0, 0.0])]
    link = spark.createDataFrame([(1, "p", "u", "a", "0", 0.12345)], S.LINKS)
    S.append_links(link, at("l"))
    S.append_links(link, at("l"))
    assert [tuple(r) for r in S.read_links(spark, at("l")).collect()] == [(1, "p", "u", "a", "0", 0.123)] * 2
    nodes, edges = S.read_graph(spark.createDataFrame([("1\t0.5",), ("1\t2\t0.3",), ("x",), ("a\tb\tc\td",)], "value string"))
    assert [tuple(r) for r in nodes.collect()] == [("1", 0.5)] and [tuple(r) for r in edges.collect()] == [("1", "2", 0.3)]


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml import PipelineModel

    df = K.with_tokens(spark.createDataFrame([(k, "good fine nice" if k % 2 else "bad worse ugly", float(k % 2)) for k in range(20)], "id int, text string, label double"))
    m = K.binary(select=False).fit(df)
    m.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    got = K.scored(again, df).collect()
    assert all(r["prediction"] == r["label"] and 0.5 <= r["prob"] <= 1 for r in got)


def test_streams(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h.org/p{k}", f'<a href="/p{k + 1}">next page {k}</a><a href="/q">same one</a>') for k in range(4)], R.PAGE)
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    score = lambda links: links.select("url", "parent_url", F.lit(0.5).alias("node_weight"), F.lit("0").alias("label"), F.lit(0.9).alias("prob"))
    for _ in range(2):  # a second run finds nothing new and changes nothing
        R.crawl(R.pages(spark, str(tmp_path / "in")), score, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    assert sorted(r["url"] for r in R.frontier(spark, str(tmp_path / "out")).collect()) == ["http://h.org/p4", "http://h.org/q"]


def test_unique_in_stream(spark, tmp_path):
    spark.createDataFrame([("u", 1), ("u", 2), ("v", 3)], "url string, n int").withColumn("ts", F.timestamp_seconds(F.col("n"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("url string, n int, ts timestamp").parquet(str(tmp_path / "in"))
    R.unique(s).writeStream.format("memory").queryName("uniq").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["url"] for r in spark.table("uniq").collect()) == ["u", "v"]
