import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from conftest import ROOT


def test_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["url", "level", "priority", "request"] and df.count() > 0
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and len(q) > 100


def test_without_the_llm_folders(tmp_path):
    """The driver deletes them with the pipeline; all else must still import."""
    shutil.copytree(f"{ROOT}/gleaner", tmp_path / "gleaner", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k == 'pipeline' or k[:2] == 'op' and k[2:3].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_an_error_within_is_not_hidden(tmp_path):
    shutil.copytree(f"{ROOT}/gleaner", tmp_path / "gleaner", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True).returncode
