import random
import re

import odd
import pytest

from gleaner.llm import decontamination

ITEMS = "item_id long, text string, doc_id string, t int"


def words(t):
    """Runs of letters and digits; a Chinese character is a word."""
    return [w for run in re.findall(r"[^\W_]+", (t or "").lower()) for w in re.findall("[\u4e00-\u9fff]|[^\u4e00-\u9fff]+", run)]


def tiling(item, doc, least=5):
    """Lengths of greedy tiles, by trying all runs of each length."""
    used_i, used_d, out = [False] * len(item), [False] * len(doc), []
    for n in range(min(len(item), len(doc)), least - 1, -1):
        where = {}
        for i in range(len(item) - n + 1):
            where.setdefault(tuple(item[i : i + n]), []).append(i)
        for d in range(len(doc) - n + 1):
            for i in where.get(tuple(doc[d : d + n]), []):
                if not any(used_d[d : d + n]) and not any(used_i[i : i + n]):
                    used_d[d : d + n] = used_i[i : i + n] = [True] * n
                    out.append(n)
                    break
    return out


def brute(docs, items, coverage=0.5):
    out = []
    for k, it in items:
        item = words(it)
        seeds = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
        for i, t in docs:
            doc = words(t)
            if seeds and any(tuple(doc[d : d + 5]) in seeds for d in range(len(doc) - 4)):
                n = tiling(item, doc)
                if sum(n) >= coverage * len(item):
                    out.append((i, k, len(n), sum(n), len(item)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "item_id", "n_tiles", "covered", "item_words").collect()), key=repr)


def test_tables(spark, sf):
    d, b = odd.table(spark, sf, "documents"), odd.table(spark, sf, "benchmark")
    want = brute([tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in b.select("item_id", "text").collect()])
    assert want and got(decontamination.matches(d, b)) == want


def planted():
    """Passages whole, cut up and put in another order, in part, and within long texts; repeats within items and documents."""
    rng = random.Random(9)
    pick = lambda n: [rng.choice([f"v{k}" for k in range(60)]) for _ in range(n)]
    items = [pick(rng.randrange(5, 60)) for _ in range(12)] + [["same"] * 20, pick(6) * 4, pick(4), []]
    docs = []
    for it in items:
        a, b = len(it) // 3, 2 * len(it) // 3
        docs += [pick(30) + it + pick(30), pick(5) + it[b:] + pick(3) + it[a:b] + pick(2) + it[:a], it[: len(it) // 2 - 1], it[: (len(it) + 1) // 2], pick(300) + it[:b] + pick(2000), [x for w in it for x in (w, "zz")]]
    docs += [["same"] * 9, ["same"] * 11 + ["x"] + ["same"] * 11]
    text = lambda w: " ".join(w).replace("v1 ", "V1, ").replace("v2 ", "v2—v2 ")
    return [(k, text(w)) for k, w in enumerate(docs)], [(k, text(w)) for k, w in enumerate(items)]


@pytest.mark.parametrize("block", [300, 4 << 20])
def test_planted(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    docs, items = planted()
    docs += [(r[0], r[1]) for r in odd.rows()]
    docs += [(3, "a clean text under the id of another"), (None, docs[0][1]), (900, "“V1”…" + docs[0][1].replace(" ", "\u00a0")), (901, "他说" + "我们今天学习历史和数学问题" + "吗"), (902, "我们今天学习"), (903, None)]
    items += [(60, "我们今天学习历史和数学问题"), (50, None), (51, ""), (None, items[0][1]), items[3], items[3]]
    d = spark.createDataFrame([(*r, 1, "x", "y") for r in docs], "doc_id long, text string, item_id int, t string, covered string").repartition(4)
    b = spark.createDataFrame([(*r, "q", 2) for r in items], ITEMS)
    want = brute(docs, items)
    assert got(decontamination.matches(d, b)) == want
    out = decontamination.decontaminated(d, b)
    assert out.columns == d.columns
    clean = [r for r in docs if not brute([r], items)]
    assert len(clean) < len(docs) and sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(clean, key=repr)


def test_empty(spark):
    docs, items = odd.documents(spark), spark.createDataFrame([], ITEMS)
    assert decontamination.matches(docs, items).count() == 0
    assert decontamination.decontaminated(docs, items).count() == docs.count()
    assert decontamination.matches(odd.empty(spark), spark.createDataFrame([(1, "a b c d e f", "", 1)], ITEMS)).count() == 0
