import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_operators_for_training_data(tmp_path):
    for part in ("tessella", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / part
        if source.is_dir():
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        elif source.exists():
            shutil.copy(source, tmp_path / part)
    code = "import re, __spark_entry__ as e; n = set(e.queries()); assert not any(re.match('op[0-9]+_|pipeline$', k) for k in n) and set(e.oracle_sql()) <= n and len(n) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_oracle_names_are_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
