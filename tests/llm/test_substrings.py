import hashlib

import odd
import pytest

from gleaner.llm import substrings


def brute(rows, n):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_tables(spark, sf):
    d = odd.table(spark, sf, "documents")
    want = brute([tuple(r) for r in d.select("doc_id", "text").collect()], 50)
    assert got(substrings.deduplicated(d)) == want
    assert any(x[2] for x in want)


@pytest.mark.parametrize("window", [2, 5, 50])
def test_odd(spark, window):
    rows = [(substrings.LAST if r[0] is None else r[0], r[1]) for r in odd.rows()]
    want = sorted(((None if r[0] == substrings.LAST else r[0], *r[1:]) for r in brute(rows, window)), key=repr)
    assert got(substrings.deduplicated(odd.documents(spark), window=window)) == want


def test_texts_and_empty(spark):
    d = substrings.deduplicated(odd.documents(spark, clashing=False), keep_text=True)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in d.collect())
    assert substrings.deduplicated(odd.empty(spark)).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_that_only_weak_hashes_take_for_equal(spark):
    """A Thue-Morse word and its complement, which collide under any odd base modulo a power of two."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([*map(str, range(49)), word])), (2, " ".join([*map(str, range(49)), other])), (3, " ".join([other] * 60)), (4, " ".join([word] * 60)), (5, " ".join([word] * 60 + ["x" * 200_000]))]
    want = brute(rows, 50)
    assert want[1][2] == 0 and want[3][2] == 0 and want[4][2] == 60
    assert got(substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_groups_under_a_weak_hash(monkeypatch):
    import random

    import numpy as np

    rng, sound = random.Random(3), substrings.span_hashes
    monkeypatch.setattr(substrings, "span_hashes", lambda *a: sound(*a) & np.uint64(3))
    for n in (2, 5):
        strings = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(n, 40))) for _ in range(60)]
        lengths = np.array([s.count(" ") + 1 for s in strings])
        owner, order, start = substrings.window_groups(" ".join(strings).encode(), lengths, n)
        windows = [tuple(s.split()[k : k + n]) for s in strings for k in range(s.count(" ") + 2 - n)]
        groups = [[windows[w] for w in order[a:b]] for a, b in zip(start, [*start[1:], len(order)])]
        assert sorted(order) == list(range(len(windows))) and all(len(set(g)) == 1 for g in groups) and len(groups) == len(set(windows))


@pytest.mark.parametrize("hot", ["all", "some"])
def test_hot_minimisers(spark, monkeypatch, hot):
    """Every document holds one line of four words; windows with it are dealt out by another minimiser."""
    import random

    import numpy as np

    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage = words(60)
    rows = [(k, " ".join(words(30) + ["all", "rights", "reserved", "by"] + words(30) + passage[: k % 60] + words(k % 7))) for k in range(300)]
    monkeypatch.setattr(substrings, "HOT", 0) if hot == "all" else monkeypatch.setattr(substrings, "hot_cells", lambda d, cells, window: np.array([0, cells - 1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    if hot == "all":
        cells = substrings.hot_cells(substrings._narrow(df, "doc_id", "text"), 64, 50)
        assert len(cells) > 32
    assert got(substrings.deduplicated(df)) == brute(rows, 50)
