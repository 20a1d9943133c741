"""The registered queries without the training-data package."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_training_data_package(tmp_path):
    shutil.copytree(os.path.join(ROOT, "clausekit"), tmp_path / "clausekit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
            "assert len(q) >= 80 and set(o) <= set(q) and not any(k.startswith('op') and k[2].isdigit() for k in q); "
            "assert 'pipeline' not in q")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
