import numpy as np
import odd
import pytest
from xxhash import xxh64_intdigest

from gleaner.llm import simhash


def plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, radius=3):
    """{value: representative} by comparing all values."""
    v = np.array(sorted(nodes), np.uint64)
    root = list(range(len(v)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= radius):
            root[find(int(j))] = find(i)
    return {int(x): find(i) for i, x in enumerate(v)}


def brute(rows):
    fps = [(i, plain(t)) for i, t in rows]
    group = components({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[group[f]] = min(least.get(group[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(group[f])) for i, f in fps), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_tables(spark, sf):
    d = odd.table(spark, sf, "documents")
    want = brute([tuple(r) for r in d.select("doc_id", "text").collect()])
    assert got(simhash.groups(d)) == want
    assert len({x[2] for x in want}) < len(want)


def test_odd(spark):
    assert got(simhash.groups(odd.documents(spark))) == brute([r[:2] for r in odd.rows()])


def family(rng, n=400):
    """Fingerprints in chains and clusters about a few centres."""
    out = []
    for c in rng.integers(0, 1 << 63, 6, dtype=np.uint64):
        x = int(c)
        for _ in range(n // 12):
            out.append(x)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
    out += [int(x) for x in rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)]
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("fan", [2, 8])
def test_gray_index_finds_all(fan):
    v = family(np.random.default_rng(fan))
    want = {(i, int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 3)}
    assert {(int(a), int(b)) for x, y in simhash.GrayIndex(v, fan).search(v, 3, 64) for a, b in zip(x, y)} == want


@pytest.mark.parametrize("hot", [5, 200_000])
def test_links_lose_no_component(spark, monkeypatch, hot):
    """With blocks of bits so common that they are dealt out again, too."""
    monkeypatch.setattr(simhash, "INDEX_ROWS", hot)
    v = family(np.random.default_rng(7))
    low = np.unique(np.concatenate([v, (np.uint64(0xABCD) << np.uint64(48)) | (v & np.uint64(0xFFFFFFFF))]))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in low.view(np.int64)], "fp long")).collect()
    group = components({int(x) for x in low})
    root = {x: x for x in group}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        a, b = (int(np.int64(x).view(np.uint64)) for x in e)
        assert (a ^ b).bit_count() <= 3 or group[a] == group[b]
        root[find(a)] = find(b)
    pairs = {}
    for x in group:
        pairs.setdefault(find(x), set()).add(group[x])
    assert all(len(s) == 1 for s in pairs.values()) and len(pairs) == len(set(group.values()))


def test_deduplicated(spark):
    docs = odd.documents(spark)
    want = {(i, c) for i, _, c in brute([r[:2] for r in odd.rows()])}
    gone = {i for i in {i for i, _ in want if i is not None} if all(c != i for j, c in want if j == i)}
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted((r[0] for r in odd.rows() if r[0] not in gone), key=repr)


def test_empty(spark):
    assert simhash.groups(odd.empty(spark)).count() == 0
    assert simhash.deduplicated(odd.empty(spark)).count() == 0
