import os
import zlib

import numpy as np
import odd
import pytest

from gleaner.llm import toxicity
from gleaner.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def tables(spark):
    return odd.table(spark, SF, "documents"), odd.table(spark, SF, "labels")


@pytest.fixture(scope="module")
def scores(spark):
    return {r["doc_id"]: r for r in QUERIES["op4_toxicity"](spark, SF).collect()}


def test_held_out_accuracy(tables, scores):
    docs, labels = tables
    assert len(scores) == docs.count()
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    for i, r in scores.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(y[i], r["predicted"]) for i, r in scores.items() if r["held_out"] and i in y]
    assert held and np.mean([bool(p) == bool(t) for t, p in held]) > 0.9


def auc(pos, neg):
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_held_out_ranking(spark):
    """On the largest table at hand, as the small ones hold six toxic rows or fewer that are held out."""
    big = next(d for d in (os.path.join(os.path.dirname(SF), "sf0.1"), SF) if os.path.exists(d))
    y = {r["doc_id"]: r["toxic"] for r in odd.table(spark, big, "labels").collect()}
    held = [(y[r["doc_id"]], r["score"]) for r in QUERIES["op4_toxicity"](spark, big).where("held_out").collect() if r["doc_id"] in y]
    pos, neg = [s for t, s in held if t], [s for t, s in held if not t]
    assert pos and neg and auc(pos, neg) > 0.9
    assert np.mean([(s >= 0.5) == bool(t) for t, s in held]) > 0.9


def test_held_out_passages():
    texts, y, *_ = _planted()
    s = toxicity.train(texts[:300], y[:300]).scores(texts[300:])
    assert auc(s[y[300:] == 1], s[y[300:] == 0]) > 0.95


def test_labels_of_held_out_rows_are_not_read(tables, scores):
    from pyspark.sql import functions as F

    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumns({"source": F.lit("x"), "lang": F.lit(None).cast("string")})
    assert {r["doc_id"]: r["score"] for r in toxicity.scored(other, turned).collect()} == {i: r["score"] for i, r in scores.items()}


def test_gradients():
    """The training step's gradients against differences of the loss."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["bad", "good", "fine", "words", "more"], 20)).encode() for _ in range(12)]
    m = toxicity.train(texts, np.arange(12) % 2, passes=1)
    x = toxicity.Inputs.gathered(texts)
    at, owner = x.windows()
    y = (owner % 2).astype(np.float64)

    def loss():
        z = np.concatenate([m.logits(x)[0]]).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    got = toxicity._step(m.p, m, x, at, y)
    for name in ("of", "ab", "wf", "ub", "bf", "o", "word", "char"):
        at_ = np.unravel_index(np.abs(got[name]).argmax(), got[name].shape)
        keep, e = m.p[name][at_], 1e-2
        m.p[name][at_] = keep + e
        up = loss()
        m.p[name][at_] = keep - e
        down = loss()
        m.p[name][at_] = keep
        assert abs((up - down) / (2 * e) - got[name][at_]) < 0.05 * abs(got[name][at_]) + 1e-4, name


def test_odd(spark):
    docs = odd.documents(spark)
    labels = spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(odd.rows()) if r[0] is not None] + [(None, 1), (3, None), (12345, 1)], "doc_id long, toxic int")
    out = toxicity.scored(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r["score"])
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.5 for r in out)


@pytest.mark.parametrize("labels", [[], [(3, 1)], [(k, 0) for k in range(-9, 60)]])
def test_few_labels_and_no_rows(spark, labels):
    docs, y = odd.documents(spark, clashing=False), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.scored(docs, y).count() == docs.count()
    assert toxicity.scored(odd.empty(spark), y).count() == toxicity.clean(odd.empty(spark), y).count() == 0


def _planted(seed=8):
    """Clean texts of common words, and toxic ones that hold a passage of rare ones; the words of both."""
    rng = np.random.default_rng(seed)
    common, rare = [f"plain{k:03}" for k in range(300)], [f"vile{k:02}" for k in range(24)]
    say = lambda words, n: [str(w) for w in rng.choice(words, n)]
    texts, y = [], []
    for k in range(400):
        toxic, text = k % 2, say(common, int(rng.integers(10, 220)))
        # Words of the passages stand alone in clean texts, so that one does not tell.
        for _ in range(3):
            text.insert(int(rng.integers(0, len(text))), say(rare, 1)[0])
        if toxic:
            at = int(rng.integers(0, len(text)))
            text[at:at] = say(rare, int(rng.integers(6, 17)))
        texts.append(" ".join(text).encode())
        y.append(toxic)
    return texts, np.array(y), say, common, rare


def test_a_passage_counts_the_same_at_every_offset():
    texts, y, say, common, rare = _planted()
    m = toxicity.train(texts, y)
    around = say(common, 130)
    assert m.scores([" ".join(around).encode()])[0] < 0.5
    for n in (6, 8, 11, 16):
        passage = say(rare, n)
        found = m.scores([" ".join(around[:k] + passage + around[k:]).encode() for k in range(len(around) + 1)])
        assert (found >= 0.5).all(), (n, np.flatnonzero(found < 0.5))
        # Among equal words all places are the same.
        same = m.scores([" ".join([common[0]] * k + passage + [common[0]] * (130 - k)).encode() for k in range(32, 99)])
        assert np.ptp(same) < 1e-5, n


def test_network_against_plain_loops():
    """A window's logit, number by number: vectors of words, both directions, attention."""
    texts, y, say, common, rare = _planted()
    m = toxicity.train(texts[:80], y[:80], passes=1)
    p, units = m.p, toxicity.UNITS
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for words in ([], ["a"], say(common + rare, 9), ["Ünbekannt", "x" * 300, *say(rare, 29)]):
        vectors = []
        for w in words:
            x = toxicity.Inputs([w.encode()])
            own = np.flatnonzero(m.words == x.words[0])
            marked = b"<" + w.lower().encode() + b">"
            runs = [marked[k : k + n] for n in toxicity.GRAMS for k in range(len(marked) - n + 1)]
            hashed = [int(toxicity.gram_hashes(np.frombuffer(r, np.uint8), len(r))[0] % np.uint64(toxicity.BUCKETS)) for r in runs]
            vectors.append(np.concatenate([p["word"][own[0] + 1 if len(own) else 0], np.mean([p["char"][k] for k in hashed], 0)]).astype(np.float64))
        states = {}
        for d in "fb":
            h, out = np.zeros(units), []
            for v in vectors if d == "f" else vectors[::-1]:
                gx, gh = v @ p[f"w{d}"] + p[f"b{d}"], h @ p[f"u{d}"]
                z, r = sigmoid(gx[:units] + gh[:units]), sigmoid(gx[units : 2 * units] + gh[units : 2 * units])
                n = np.tanh(gx[2 * units :] + r * gh[2 * units :])
                h = (1 - z) * n + z * h
                out.append(h)
            states[d] = out if d == "f" else out[::-1]
        score = np.array([f @ p["af"] + b @ p["ab"] for f, b in zip(states["f"], states["b"])])
        value = np.array([f @ p["of"] + b @ p["ob"] for f, b in zip(states["f"], states["b"])])
        weight = np.exp(score - score.max()) if len(score) else score
        want = (weight / weight.sum() * value).sum() + p["o"][0] if len(score) else p["o"][0]
        assert abs(m.logits(toxicity.Inputs([" ".join(words).encode()]))[0][0] - want) < 1e-4


def test_every_window_is_scored_alone():
    """All windows of short, long and empty texts, against each as a text of its own."""
    texts, y, say, common, rare = _planted()
    m = toxicity.train(texts, y, passes=2)
    lengths = [0, 1, 31, 32, 33, 63, 64, 65, 0, 150, 2, 2300]
    words = [say(common + rare, n) for n in lengths]
    own = [[w[k : k + 32] for k in range(max(1, len(w) - 31))] for w in words]
    logit, owner = m.logits(toxicity.Inputs([" ".join(w).encode() for w in words]))
    assert owner.tolist() == [k for k, w in enumerate(own) for _ in w]
    alone = m.logits(toxicity.Inputs([" ".join(w).encode() for some in own for w in some]))[0]
    assert np.abs(logit - alone).max() < 1e-4
    best = m.scores([" ".join(w).encode() for w in words])
    assert np.allclose(best, [1 / (1 + np.exp(-logit[owner == k].max())) for k in range(len(words))], atol=1e-5)


def test_power_against_exp():
    """Gates by _power against gates by exp, down to the floor and up to where it overflows."""
    v = np.concatenate([np.linspace(toxicity._LEAST_V, 40, 50_001), [-1e4, -200, 200, 1e4, 1e9]]).astype(np.float32)
    floor = np.float32(toxicity._SLOPE * toxicity._LEAST_V + toxicity._SHIFT)
    with np.errstate(over="ignore"):
        e = toxicity._power(toxicity._SLOPE * v + toxicity._SHIFT, np.empty_like(v), floor)
        assert np.abs(1 / (1 + e.astype(np.float64)) - 1 / (1 + np.exp(v.astype(np.float64)))).max() < 2e-6


def test_weights_of_any_size():
    """Steps far beyond what a trained network has: the gates are shut or open, not wrong."""
    texts, y, say, common, rare = _planted()
    m = toxicity.train(texts[:80], y[:80], passes=1)
    for d in "fb":
        m.p[f"w{d}"] = m.p[f"w{d}"] * 400
    x = toxicity.Inputs(texts[:9])
    at, owner = x.windows()
    got, v = m.logits(x)[0], m.vectors(x)
    sigmoid = lambda a: 1 / (1 + np.exp(-np.clip(a, -700, 700)))
    assert max(np.abs(v @ m.p[f"w{d}"]).max() for d in "fb") > 2 * -toxicity._LEAST_V
    for k in range(0, len(at), 97):
        g = {d: v[x.seq[at[k][at[k] >= 0]]].astype(np.float64) @ m.p[f"w{d}"] + m.p[f"b{d}"] for d in "fb"}
        states = {}
        for d in "fb":
            h, out, u, n_ = np.zeros(toxicity.UNITS), [], m.p[f"u{d}"], toxicity.UNITS
            for row in g[d] if d == "f" else g[d][::-1]:
                gh = h @ u
                z, r = sigmoid(row[:n_] + gh[:n_]), sigmoid(row[n_ : 2 * n_] + gh[n_ : 2 * n_])
                h = (1 - z) * np.tanh(row[2 * n_ :] + r * gh[2 * n_ :]) + z * h
                out.append(h)
            states[d] = np.array(out if d == "f" else out[::-1])
        score = states["f"] @ m.p["af"] + states["b"] @ m.p["ab"]
        weight = np.exp(score - score.max())
        want = (weight / weight.sum() * (states["f"] @ m.p["of"] + states["b"] @ m.p["ob"])).sum() + m.p["o"][0]
        assert abs(got[k] - want) < 1e-3


def test_equal_windows_are_scored_once(monkeypatch):
    """The same passage in many texts costs its windows once, and each text still gets all of its own."""
    texts, y, say, common, rare = _planted()
    m = toxicity.train(texts[:80], y[:80], passes=1)
    shared = say(common, 400)
    some = [" ".join([*say(common + rare, 40), *shared, *say(common + rare, 40)]).encode() for _ in range(30)]
    alone = np.concatenate([m.logits(toxicity.Inputs([t]))[0] for t in some])
    counted, pooled = [], toxicity.Model._pooled
    monkeypatch.setattr(toxicity.Model, "_pooled", lambda self, inputs, heads, size, *more: counted.append(size) or pooled(self, inputs, heads, size, *more))
    logit, owner = m.logits(toxicity.Inputs(some))
    assert np.abs(logit - alone).max() < 1e-4 and len(logit) == 30 * (480 - 31)
    assert sum(counted) < len(logit) / 2


def test_windows_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(toxicity, "span_hashes", lambda values, starts, ends: np.zeros(len(starts), np.uint64))
    words = np.concatenate([np.arange(40), np.arange(40)])
    at = np.concatenate([np.arange(9), 40 + np.arange(9)])
    first = toxicity._firsts(words, at)
    assert first[0] == first[9] == 0 and first[1:9].tolist() == list(range(1, 9))
