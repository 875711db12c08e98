"""The driver's entry module, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["entity_type", "occurrences"] and df.count() > 0


def test_every_query_of_the_engine_has_sql():
    found = [q for q in __spark_entry__.queries() if not q.startswith("op") and q != "pipeline"]
    assert len(found) >= 45 and set(found) <= set(__spark_entry__.oracle_sql())


def test_imports_without_the_training_data_subpackage(tmp_path):
    shutil.copytree(ROOT / "veilspark", tmp_path / "veilspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') or x == 'pipeline' for x in q) and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "veilspark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "veilspark.llm" not in p.read_text().replace("veilspark.llm is", ""), p
