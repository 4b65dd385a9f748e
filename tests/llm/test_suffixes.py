import hashlib
import random

import numpy as np
import odd
import pytest

from gleaner.llm import suffixes

LAST = 2**63 - 1


def brute(rows, n):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            key = b[k : k + n]
            at = (i, k)
            if key not in first or at < first[key]:
                first[key] = at
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < (i, k):
                gone[k : k + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((i, len(b), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-1])[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_tables(spark, sf):
    d = odd.table(spark, sf, "documents")
    want = brute([tuple(r) for r in d.select("doc_id", "text").collect()], 100)
    assert got(suffixes.deduplicated(d)) == want
    assert any(x[2] for x in want)


@pytest.mark.parametrize("seed", [1, 2])
def test_odd(spark, seed):
    rows = [(LAST if r[0] is None else r[0], r[1]) for r in odd.rows(seed)]
    want = sorted(((None if r[0] == LAST else r[0], *r[1:]) for r in brute(rows, 100)), key=repr)
    assert got(suffixes.deduplicated(odd.documents(spark, seed))) == want


def test_small_shards(spark):
    """Many shards for a bucket, and texts of few letters, whose anchors repeat all over."""
    rng = random.Random(5)
    part = "".join(rng.choice("ab") for _ in range(300))
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 400))) + part[: rng.randrange(0, 300)] + "ab" * rng.randrange(0, 100)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(suffixes.deduplicated(df, shard=1 << 12)) == brute(rows, 100)


def test_texts_and_empty(spark):
    d = suffixes.deduplicated(odd.documents(spark, clashing=False), keep_text=True)
    assert all(hashlib.sha256(bytes(r["text"])).hexdigest() == r["kept_sha256"] for r in d.collect())
    assert suffixes.deduplicated(odd.empty(spark)).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 200])
def test_suffix_order_and_common_prefixes(letters):
    """Against Python's sort and a count byte by byte."""
    data = np.random.default_rng(2).integers(1, 1 + letters, 700).astype(np.uint8)
    depth, text = 64, data.tobytes() + b"\0" * 64
    words = suffixes.byte_words(data)
    order, rank = suffixes.suffix_order(words, depth)
    prefixes = [text[i : i + depth] for i in order]
    assert prefixes == sorted(prefixes)
    assert [rank[a] == rank[b] for a, b in zip(order, order[1:])] == [x == y for x, y in zip(prefixes, prefixes[1:])]
    shared = suffixes.common_prefixes(words, order, rank, depth, lanes=16)
    for k in range(1, len(order)):
        x, y = (text[i : min(i + depth, len(data))] for i in order[k - 1 : k + 1])
        same = next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert shared[k] == same or prefixes[k] == prefixes[k - 1]


@pytest.mark.parametrize("hot", ["found", "all", "some"])
def test_hot_anchors(spark, monkeypatch, hot):
    """One line in every document, texts around it that differ, and passages that repeat with it."""
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(["ab", "cde", "fghi", "jk", "lmnop"]) + str(rng.randrange(1000)) for _ in range(n))
    line, passage = " all rights are reserved by the owners of this text ", say(30)
    rows = [(k, say(20) + line + (passage if k % 5 == 0 else say(20))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    if hot == "found":
        monkeypatch.setattr(suffixes, "TEXTS", 2_000)
        blocks = suffixes.stored(suffixes._blocks(df.selectExpr("doc_id", "cast(text as binary) t")))
        repeated = suffixes.stored(suffixes._repeated_anchors(blocks, 4, 100, 32))
        cells = suffixes.hot_cells(repeated, 64, 10)
        assert 0 < len(cells) < 8
        monkeypatch.setattr(suffixes, "hot_cells", lambda r, n, least, real=suffixes.hot_cells: real(r, n, 10))
        monkeypatch.setattr(suffixes, "parts_for", lambda *a, **k: 64)
    else:
        monkeypatch.setattr(suffixes, "hot_cells", lambda r, n, least: np.arange(n) if hot == "all" else np.array([0, n - 1]))
    assert got(suffixes.deduplicated(df)) == brute(rows, 100)
