"""Tokens, term statistics, weights, stems and metrics on cases worked by hand."""

import math
import random

from pyspark.sql import functions as F

from gleaner.functions import stem as S
from gleaner.functions import text as T
from gleaner.operators import evaluate as E
from gleaner.operators import sample as A
from gleaner.operators import terms as M
from gleaner.operators import votes as V

CORPUS = [(1, "a", "x y x"), (2, "a", "x z"), (3, "b", "y y"), (4, "b", "w"), (5, "b", None), (6, "b", "")]


def corpus(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, label string, text string")


def table(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_statistics(spark):
    s = {r["tok"]: r for r in M.statistics(corpus(spark)).collect()}
    assert {k: (r["tf"], r["df"], r["ldc"]) for k, r in s.items()} == {"x": (3, 2, 3), "y": (3, 2, 4), "z": (1, 1, 1), "w": (1, 1, 1)}
    assert math.isclose(s["x"]["idf"], math.log(6 // 2 + 0.01))


def test_classes(spark):
    c = M.class_counts(corpus(spark))
    assert {(r["tok"], r["label"]): (r["a"], r["b"], r["c"], r["d"]) for r in c.where("tok = 'y'").collect()} == {("y", "a"): (1, 1, 1, 3), ("y", "b"): (1, 1, 3, 1)}
    assert math.isclose(table(M.weight_rf(c), "tok", "weight")["x"], math.log(2 + 2 / 1))
    assert math.isclose(table(M.weight_idf(c), "tok", "weight")["x"], math.log(6 / 3))
    assert math.isclose(table(M.chi_reduced(c), "tok", "chi")["x"], (2 * 4 - 0) ** 2 / (2 * 4))  # two documents of a and four of b, whoever holds the word
    six = spark.createDataFrame([(1, 'a', 'x'), (2, 'a', 'x'), (3, 'a', 'y'), (4, 'b', 'x'), (5, 'b', 'y'), (6, 'b', 'y')], 'doc_id long, label string, text string')
    assert math.isclose(table(M.chi_reduced(M.class_counts(six)), 'tok', 'chi')['x'], (2 * 2 - 1 * 1) ** 2 / (3 * 3))
    four = six.where('doc_id <> 6').unionByName(six.where('doc_id = 5').withColumn('label', F.lit('a')).withColumn('text', F.lit('x y')))
    assert not math.isclose(table(M.chi_reduced(M.class_counts(four)), 'tok', 'chi')['x'], table(M.chi_full(M.class_counts(four)), 'tok', 'chi')['x'])
    assert math.isclose(table(M.chi_full(c), "tok", "chi")["x"], 6 * (2 * 4) ** 2 / (2 * 4 * 2 * 4))


def test_ratios(spark):
    r = M.label_ratios(corpus(spark))
    assert all(math.isclose(x, 1) for x in table(r.groupBy("label").agg(F.sum("p").alias("s")), "label", "s").values())
    p = {(x["label"], x["gram"]): x["p"] for x in r.collect()}
    assert math.isclose(p["a", "x"], 4 / (8 + 8)) and math.isclose(p["b", "x"], 1 / (4 + 8))  # 8 grams; a: x y, y x, x z and 5 words; b: y y and 3 words


def test_features_have_length_one(spark):
    for local in M.LOCAL:
        for weight in M.GLOBAL.values():
            f = M.features(M.tokens(corpus(spark)), weight(M.class_counts(corpus(spark))), local)
            n = table(f.groupBy("doc_id").agg(F.sum(F.col("value") * F.col("value")).alias("n")), "doc_id", "n")
            assert all(math.isclose(x, 1) or x == 0 for x in n.values())


def test_vocabulary_numbers_all(spark):
    v = table(M.vocabulary(M.tokens(corpus(spark))), "tok", "id")
    assert v == {"x": 1, "y": 2, "w": 3, "z": 4}


def test_first_seen_and_cuts(spark):
    assert table(M.first_seen(M.tokens(corpus(spark))), "tok", "id") == {"x": 0, "y": 1, "z": 2, "w": 3}
    many = spark.range(1000).select(F.col("id").cast("string").alias("tok"), (F.col("id") % 7).cast("double").alias("chi")).repartition(9)
    want = sorted(((str(k), k % 7) for k in range(1000)), key=lambda x: (-x[1], x[0]))[:300]
    assert sorted(r["tok"] for r in M.top_ratio(many, 0.3).collect()) == sorted(t for t, _ in want)
    s = spark.createDataFrame([(float(k), k % 10) for k in range(50)], "tfidf double, ldc long")
    assert tuple(M.thresholds(s, 0.1).first()) == (44.0, 8) and tuple(M.thresholds(s.where("ldc > 99"), 0.1).first()) == (None, None)


def test_per_class_model_is_saved(spark, tmp_path):
    from gleaner.operators.models import PerClass

    rng = random.Random(2)
    words = {y: [f"{y}{k}" for k in range(8)] + [f"c{k}" for k in range(8)] for y in "ab"}
    rows = [(k, "ab"[k % 2], " ".join(rng.choice(words["ab"[k % 2]]) for _ in range(12))) for k in range(120)] + [(500, None, "a1 a2"), (501, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, label string, text string")
    m = PerClass.train(df.where("doc_id < 80"), 1 << 12)
    got = {r["doc_id"]: (r["label"], r["prob"]) for r in m.predict(df).collect()}
    assert sum(got[k][0] == y for k, y, _ in rows[:120]) > 114 and got[500][0] == "a" and len(got) == len(rows)
    m.save(spark, f"file://{tmp_path}/m")
    assert {r["doc_id"]: (r["label"], r["prob"]) for r in PerClass.load(spark, f"file://{tmp_path}/m").predict(df).collect()} == got


def test_splits(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("label", F.col("doc_id") % 2)
    s = A.split(df, "doc_id", 20, 10, 5).collect()
    assert sorted(r["part"] for r in s) == ["test"] * 10 + ["train"] * 20 and len({r["doc_id"] for r in s}) == 30
    b = A.balanced(df, "doc_id", "label", 7)
    assert {tuple(r) for r in b.groupBy("label", "part").count().collect()} == {(y, p, 7) for y in (0, 1) for p in ("train", "test")}


def test_stems():
    """Words of the published description and its regions."""
    for w, s in {"caresses": "caress", "ponies": "poni", "cats": "cat", "gas": "gas", "agreed": "agre", "plastered": "plaster", "hopping": "hop", "hoping": "hope", "falling": "fall", "happy": "happi", "cry": "cri", "by": "by", "relational": "relat", "vietnamization": "vietnam", "generously": "generous", "communism": "communism", "skis": "ski", "dying": "die", "news": "news", "inning": "inning", "exceeding": "exceed", "rate": "rate", "controlling": "control", "sensational": "sensat", "knightly": "knight", "'tis": "tis", "dog's": "dog", "yes": "yes", "sayyid": "sayyid"}.items():
        assert S.stem(w) == s, w


def test_word_break():
    known = frozenset({"red", "shoe", "shoes", "a", "b", "ab"})
    assert S.word_break("redshoes", known) == ["red", "shoes"]
    assert S.word_break("redx", known) is None and S.word_break("", known) is None
    assert S.word_break("ab" * 3000 + "x", known) is None and len(S.word_break("ab" * 3000, known)) == 3000


def test_dictionary_segments(spark):
    from gleaner.functions import segment as G

    known = {"北京": 10, "大学": 8, "北京大学": 20, "生": 2, "大学生": 6, "活": 1, "生活": 9}
    assert G.precise("北京大学生活好", known, 4) == ["北京大学", "生活", "好"]
    assert G.full("北京大学生", known, 4) == ["北京", "北京大学", "大学", "大学生"] and G.full("好北京x", known, 4) == ["好", "北京", "x"]
    df = spark.createDataFrame([(1, "北京 大学生"), (2, None), (3, "")], "i int, t string")
    assert [r["w"] for r in df.select("i", G.segmenter(known)(F.col("t")).alias("w")).orderBy("i").collect()] == [["北京", "大学生"], None, []]


def test_bundle_and_report(spark, tmp_path):
    from gleaner.operators import models as K

    df = spark.createDataFrame([(k, "good fine nice" if k % 2 else "bad worse ugly", "red" if k % 2 else "blue", float(k % 2)) for k in range(40)], "id int, text string, anchor string, label double")
    one = K.hashed(1 << 8)
    m, report = K.reported(one, K.with_tokens(df.where("id < 30")), K.with_tokens(df.where("id >= 30")))
    assert sorted(tuple(r) for r in report.collect()) == [(0.0, "100.00%", "100.00%"), (1.0, "100.00%", "100.00%")]
    b = K.Bundle({"para": (m, "text"), "url": (one.fit(K.with_tokens(df, "anchor")), "link")})
    b.save(spark, f"file://{tmp_path}/b")
    rule = F.when(F.col("id") == 3, F.struct(F.lit("0").alias("label"), F.lit(1.0).alias("prob")))
    got = {r["id"]: r for r in K.Bundle.load(spark, f"file://{tmp_path}/b").predict(df.withColumnRenamed("anchor", "link"), url=rule).collect()}
    assert all(r["para"]["label"] == str(i % 2) for i, r in got.items()) and all(r["url"]["label"] == ("0" if i == 3 else str(i % 2)) for i, r in got.items())
    line = K.json_map(spark.createDataFrame([("u", 1.0, 0.75)], "url string, prediction double, prob double"), "url").first()[0]
    assert line == '{"u":["1","0.750000"]}'
    own = K.binary(select=False, converter=[K.HashingTF(inputCol="tokens", outputCol="counts", numFeatures=64)])
    assert own.fit(K.with_tokens(df)).transform(K.with_tokens(df)).where("prediction = label").count() == 40


def plain_lcs(a, b, same):
    row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            row[i][j] = row[i - 1][j - 1] + 1 if same(x, y) else max(row[i - 1][j], row[i][j - 1])
    return row[-1][-1]


def test_lcs(spark):
    rng = random.Random(3)
    rows = [([rng.choice(["a", "b", "ab", "abc", "c"]) for _ in range(rng.randrange(0, 30))], [rng.choice(["a", "b", "ab", "abc", "c"]) for _ in range(rng.randrange(0, 30))]) for _ in range(60)] + [(None, ["a"]), ([], [])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a array<string>, b array<string>")
    for r in df.select("k", T.lcs("a", "b").alias("x"), T.lcs_within("a", "b").alias("y")).collect():
        a, b = rows[r["k"]]
        assert (r["x"], r["y"]) == (plain_lcs(a or [], b or [], str.__eq__), plain_lcs(a or [], b or [], lambda x, y: x in y))


def test_metrics(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", "d")], "truth string, predicted string")
    m = {r["label"]: (r["hit"], r["n_predicted"], r["n_true"], r["precision"], r["recall"]) for r in E.by_label(p).collect()}
    assert m["a"] == (1, 1, 3, 1.0, 1 / 3) and m["c"] == (0, 0, 1, 0.0, 0.0) and m["d"] == (0, 1, 0, 0.0, 0.0)
    mm = E.micro_macro(p).first()
    assert math.isclose(mm["micro"], 0.4) and math.isclose(mm["macro"], (1 / 3 + 1 + 0) / 3)
    f = E.f_score(spark.createDataFrame([(1, 0.5), (1, -1.0), (-1, 0.0), (-1, -2.0)], "truth int, value double")).first()
    assert (f["precision"], f["recall"], f["f_score"]) == (0.5, 0.5, 0.5)
    t = E.trimmed_mean(spark.createDataFrame([("k", x) for x in (0.0, 1.0, 2.0, 3.0, 10.0)], "key string, x double"), "key", "x").first()
    assert (t["mean"], t["n"]) == (2.5, 4)
    assert E.trimmed_mean(spark.createDataFrame([("k", 1.0)], "key string, x double"), "key", "x").first()["mean"] is None


def vote(spark, column):
    return spark.range(1).select(column).first()[0]


def test_votes(spark):
    pair = lambda y, p: F.struct(F.lit(y).alias("label"), F.lit(p).alias("prob"))
    assert tuple(vote(spark, V.majority(F.array(pair("0", 0.6), pair("1", 0.9), pair("0", 0.55))))) == ("0", 0.6)
    assert tuple(vote(spark, V.majority(F.array(pair("0", 0.6), pair("1", 0.9))))) == ("1", 0.9)
    assert vote(spark, V.majority(F.array(pair("0", 0.1), pair("1", 0.2)))) is None
    assert [vote(spark, V.ternary(F.lit(y), F.lit(p))) for y, p in (("0", 0.6), ("0", 0.7), ("1", 0.9))] == [0, 1, -1]
    assert vote(spark, V.url_and_text(F.lit("1"), F.lit(0.8), F.lit("0"), F.lit(0.7))) == "1"
    assert vote(spark, V.url_and_text(F.lit("1"), F.lit(0.95), F.lit("0"), F.lit(0.9))) == "0"
    r = V.one_vs_one(spark.createDataFrame([(1, [1.0, -2.0, -3.0])], "id int, vals array<double>")).first()
    assert (r["winner"], r["score"]) == (2, (2 + 3) / 4 + 2 / 4)
