"""The entry points without their optional part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

from conftest import ROOT

from checkset import registry

LIST = "import __spark_entry__ as e; print(*e.queries(), sep='\\n'); assert set(e.oracle_sql()) <= set(e.queries())"


def queries_of(folder: str) -> set[str]:
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def copied(folder, *left_out: str) -> str:
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", ".*_cache", *left_out))
    return str(folder)


def test_entry_without_the_corpus_operators(tmp_path):
    everything = set(registry.QUERIES)
    assert queries_of(copied(tmp_path / "folders", "llm")) == everything
    assert queries_of(copied(tmp_path / "all", "llm", "corpus_pipeline.py")) == everything


def test_entry_registers_every_core_query():
    assert set(registry.QUERIES) <= queries_of(ROOT)
    assert os.path.exists(f"{ROOT}/__spark_entry__.py")
