from fractions import Fraction

import odd
import pytest
from compare import duck, of_spark
from pyspark.sql import functions as F

from gleaner.llm import mixing
from gleaner.llm.queries import ORACLE_SQL, QUERIES


def targets(sizes):
    """By sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    cap = {s: 3 * sizes[s] for s in sizes}
    total, full = Fraction(sum(sizes.values())), {}
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(full.values())
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > cap[s]]
        if not over:
            return {s: Fraction(full[s]) if s in full else level * weight[s] for s in order}
        full |= {s: cap[s] for s in over}


def test_sql(spark, sf):
    assert of_spark(QUERIES["op6_mixing"](spark, sf)) == duck(sf, ORACLE_SQL["op6_mixing"])


def check(rows, docs):
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for r in docs:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    want = targets(sizes) if sizes else {}
    assert sorted((r["doc_id"], r["source"], r["size"]) for r in rows if r["doc_id"] is not None and r["source"]) == sorted((r[0], r[3], size(r[1])) for r in docs if r[0] is not None and r[3])
    assert len(rows) == len(docs)
    taken = {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["n_words"] for p in r["pieces"])
        assert all(0 <= p["from_word"] and p["from_word"] + p["n_words"] <= r["size"] and p["n_words"] > 0 for p in r["pieces"])
        for e in range(3):  # pieces of one pass do not meet
            spans = sorted((p["from_word"], p["from_word"] + p["n_words"]) for p in r["pieces"] if p["epoch"] == e)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.5


@pytest.mark.parametrize("block,stretch", [(1024, 4096), (7, 3)])
def test_odd(spark, monkeypatch, block, stretch):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "STRETCH", stretch)
    check(mixing.mixed(odd.documents(spark)).collect(), odd.rows())


def test_table_and_reruns(spark, sf):
    d = odd.table(spark, sf, "documents")
    one = mixing.mixed(d)
    check(one.collect(), [tuple(r) for r in d.collect()])
    again = mixing.mixed(d.repartition(13, F.xxhash64("text")))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, again.collect()))


def test_shards(spark, sf, monkeypatch):
    """The mix itself: shards of equal size but for blocks, words as they stand in the texts, as many as taken."""
    monkeypatch.setattr(mixing, "BLOCK", 64)
    d = odd.table(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\t "), F.regexp_replace("text", " ", " \n"), F.lit(" "))).otherwise(F.col("text")))
    out = mixing.shards_of(d, shards=5, keep=("lang",), slot=500).collect()
    n = {}
    for r in out:
        assert len(r["text"].encode().split()) == r["n_words"] and r["lang"]
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + r["n_words"]
    assert n == {r["doc_id"]: r["taken"] for r in mixing.mixed(d, shards=5).collect() if r["taken"]}
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in out:
        words, whole = r["text"].encode().split(), text[r["doc_id"]].encode().split()
        assert r["text"] in text[r["doc_id"]] and words == whole[r["from_word"] : r["from_word"] + r["n_words"]]
    blocks, rows = {}, {}
    for r in out:
        blocks.setdefault((r["source"], r["epoch"], r["block"]), set()).add(r["shard"])
        rows.setdefault(r["shard"], []).append(r["doc_id"])
    assert all(len(s) == 1 for s in blocks.values())  # shards are disjoint
    count = [sum(1 for s in blocks.values() if s == {k}) for k in range(5)]
    assert max(count) - min(count) <= 1
    assert all(x != sorted(x) for x in rows.values())


@pytest.mark.parametrize("change", [{"shards": 3}, {"seed": 8}])
def test_what_is_taken_hangs_on_the_tree(spark, monkeypatch, change):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = [(k, " ".join(["w"] * 40), "en", "ab"[k % 2] if k < 90 else "c", 1) for k in range(100)]
    df = spark.createDataFrame(rows, odd.DOCS)
    a, b = ({r["doc_id"]: r["taken"] for r in mixing.mixed(df, **c).collect()} for c in ({}, change))
    assert a != b and sum(a.values()) == sum(b.values())
    if "shards" in change:  # the order of the lines is the same, so the tree alone makes the difference
        monkeypatch.setattr(mixing, "split", lambda q, n, seed, split=mixing.split: split(q, n, seed + 1))
        assert {r["doc_id"]: r["taken"] for r in mixing.mixed(df).collect()} != a


def test_splitting_tree(spark):
    """Exact sums both ways, and means and variances of a draw without replacement."""
    quotas = [3, 0, 40, 17, 1]
    got = []
    for seed in range(60):
        rows = mixing.split(spark.createDataFrame([(quotas,)], "q array<bigint>").coalesce(1), 4, seed).orderBy("shard").collect() if seed < 6 else None
        if rows is None:
            break
        x = [list(r["x"]) for r in rows]
        assert [sum(c) for c in zip(*x)] == quotas
        assert max(map(sum, x)) - min(map(sum, x)) <= 1
        got.append(x)
    assert len({repr(x) for x in got}) > 1
    u = "((id + 0.5D) / 20000D)"
    draws = spark.range(20000).select(F.expr(mixing._hypergeometric("30L", "100L", "20L", u)).alias("h")).agg(F.avg("h"), F.var_pop("h")).first()
    assert abs(draws[0] - 6) < 0.01 and abs(draws[1] - 20 * 0.3 * 0.7 * 80 / 99) < 0.02


def test_empty(spark):
    assert mixing.mixed(odd.empty(spark)).count() == 0
    wordless = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, None)], odd.DOCS)
    assert [(r["target"], r["taken"]) for r in mixing.mixed(wordless).collect()] == [(0, 0), (0, 0)]
