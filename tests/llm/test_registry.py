import re

import __spark_entry__ as entry
import corpus_pipeline


def test_one_query_for_each_operator():
    q = entry.queries()
    assert sorted(int(m[1]) for k in q if (m := re.match(r"op(\d+)_", k))) == list(range(1, 11))
    assert "pipeline" in q and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "pii", "mixing"]
    assert set(entry.oracle_sql()) <= set(q)
