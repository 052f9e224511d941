"""The library without its training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root):
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    # Without PYTHONPATH, which may lead to the repository and to what was left out of the copy.
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if "site-packages" in p or "dist-packages" in p)}
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True, env=env)
    return set(done.stdout.rpartition("NAMES")[2].split())


def copied(tmp_path, *without):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", *without))
    return tmp_path / "copy"


def test_queries_without_the_training_data_subpackage(tmp_path):
    """corpus_pipeline.py may stay behind or go; the other queries are there in both cases."""
    root = copied(tmp_path, "llm")
    left = names(root)
    assert len(left) > 100 and not any(n == "pipeline" or n.startswith("op1_") for n in left)
    if (root / "corpus_pipeline.py").exists():
        (root / "corpus_pipeline.py").unlink()
        assert names(root) == left


def test_queries_without_the_pipeline(tmp_path):
    root = copied(tmp_path, "corpus_pipeline.py")
    assert "pipeline" not in names(root)
