"""The entry point without the optional operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=300)


def test_the_rest_stands_alone(tmp_path):
    """A copy without the optional operators imports, with or without the file that is made of them."""
    for k, gone in enumerate([["corpus_pipeline.py"], []]):
        folder = tmp_path / str(k)
        shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.md", "*.json", *gone))
        done = run(folder, "import __spark_entry__ as e; names = set(e.queries()); assert 'split_pool_counts' in names and 'pipeline' not in names; assert not any(n.startswith('op') and n[2].isdigit() for n in names); assert set(e.oracle_sql()) <= names")
        assert done.returncode == 0, done.stderr
