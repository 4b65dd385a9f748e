"""Every query against DuckDB's rows for its SQL; queries without SQL against rules that their rows must keep."""

import pytest
from compare import duck, of_spark

from gleaner import plans

plans.load()


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_rows(spark, sf, name):
    names, rows = of_spark(plans.QUERIES[name](spark, sf))
    assert (names, rows) == duck(sf, plans.ORACLE[name])
    assert rows


ROWS_ONLY = {
    "crawl_simulation": ["step", "nid", "weight", "total"],
    "regression_scores": ["nid", "score"],
    "binary_pipeline_logistic": ["doc_id", "label", "prediction", "prob"],
    "binary_pipeline_logistic_l1": ["doc_id", "label", "prediction", "prob"],
    "binary_pipeline_svc": ["doc_id", "label", "prediction", "prob"],
    "hashed_pipeline": ["doc_id", "label", "prediction", "prob"],
    "nb_ovr_classify": ["doc_id", "label", "prob"],
    "one_vs_rest_svc": ["doc_id", "label", "prediction"],
    "cross_validation": ["method", "auc"],
    "lda_topics": ["topic", "rank", "term", "weight"],
    "cotraining": ["id", "prob"],
    "rls_fit": ["event_type", "n", "w"],
    "dom_nodes": ["page_id", "node_id", "parent_id", "last_id", "depth", "sib_idx", "tag", "attrs", "text", "tail", "content_length", "content"],
    "dom_paths": ["page_id", "node_id", "xpath"],
    "title_node_lcs": ["page_id", "node_id", "content", "lcs"],
    "neighbour_text": ["page_id", "node_id", "href", "near"],
    "article_density": ["page_id", "para"],
    "article_records": ["page_id", "title", "para"],
    "page_documents": ["page_id", "base_url", "title", "meta", "headlines", "para"],
    "extraction_comparison": ["page_id", "method", "para"],
    "lcs_score": ["page_id", "p", "r", "f1", "score"],
    "porter_stem": ["conv_id", "turn", "stems"],
    "url_word_break": ["page_id", "tokens"],
}


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows(spark, sf, name):
    df = plans.QUERIES[name](spark, sf)
    assert df.columns == ROWS_ONLY[name]
    rows = df.collect()
    assert rows
    for c in ("prob", "p", "r", "f1", "score") if name not in ("regression_scores",) else ():
        if c in df.columns:
            assert all(0 <= r[c] <= 1 for r in rows)


def test_others_run(spark, sf):
    for name in sorted(set(plans.QUERIES) - set(plans.ORACLE) - set(ROWS_ONLY)):
        assert plans.QUERIES[name](spark, sf).count() > 0, name


def test_held_out_accuracy(spark, sf):
    """Models are worth more than the most frequent label."""
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [(truth[r["doc_id"]], r["label"]) for r in plans.QUERIES["nb_ovr_classify"](spark, sf).collect() if r["doc_id"] % 5 == 0]
    most = max(sum(t == y for t, _ in got) for y in set(truth.values()))
    assert sum(t == y for t, y in got) > max(most, 0.8 * len(got))
