import os

import corpus_pipeline
import odd
import pytest
from test_decontamination import brute as leaks
from test_pii import base
from test_simhash import brute as groups

from gleaner.llm import toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def steps(spark):
    """The rows before each stage and after the last, by stage names."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        assert docs.columns == corpus_pipeline.COLUMNS or name == "mixing"
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_toxic_documents_go(spark, steps):
    docs, labels = odd.table(spark, SF, "documents"), odd.table(spark, SF, "labels")
    assert ids(steps[1]) == sorted(r["doc_id"] for r in toxicity.scored(docs, labels).collect() if r["predicted"] == 0)


def test_one_of_each_group_stays(steps):
    assert ids(steps[2]) == sorted({c for _, _, c in groups([(r["doc_id"], r["text"]) for r in steps[1]])})


def test_leaks_go(spark, steps):
    items = [tuple(r) for r in odd.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    bad = {x[0] for x in leaks([(r["doc_id"], r["text"]) for r in steps[2]], items)}
    assert bad and ids(steps[3]) == sorted(r["doc_id"] for r in steps[2] if r["doc_id"] not in bad)


def test_personal_data_goes(steps):
    before = {r["doc_id"]: r for r in steps[3]}
    assert ids(steps[4]) == ids(steps[3])
    touched = 0
    for r in steps[4]:
        was = before[r["doc_id"]]
        assert (r["lang"], r["source"]) == (was["lang"], was["source"])
        assert not base(r["text"]) and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        touched += r["text"] != was["text"]
        assert r["text"] == was["text"] if not base(was["text"]) and "<ID>" not in (r["text"] or "") else r["text"] != was["text"]
    assert 0 < touched < len(before)


def test_the_mix(steps):
    before, by, taken = {r["doc_id"]: r for r in steps[4]}, {}, {}
    for r in steps[5]:
        was = before[r["doc_id"]]
        words = (was["text"] or "").encode().split()
        assert r["text"].encode().split() == words[r["from_word"] : r["from_word"] + r["n_words"]] and r["text"] in was["text"]
        assert (r["lang"], r["source"], r["size"], r["n_chars"]) == (was["lang"], was["source"], len(words), len(r["text"]))
        taken.setdefault(r["doc_id"], []).extend((r["epoch"], k) for k in range(r["from_word"], r["from_word"] + r["n_words"]))
        by.setdefault(r["source"], [r["target"], 0])[1] += r["n_words"]
    assert all(abs(t - n) <= 0.5 for t, n in by.values())
    assert all(len(set(x)) == len(x) <= 3 * len((before[k]["text"] or "").encode().split()) for k, x in taken.items())
    assert len({r["shard"] for r in steps[5]}) > 1 and any(r["n_words"] < r["size"] for r in steps[5]) and any(r["epoch"] for r in steps[5])


def test_run(spark, steps):
    assert sorted(map(repr, corpus_pipeline.run(spark, SF).collect())) == sorted(map(repr, steps[5]))


def test_stages_on_nothing(spark):
    docs = odd.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
