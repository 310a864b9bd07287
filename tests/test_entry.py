"""The entry lists the invoice queries whatever becomes of the training-data part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

from belegwerk.plans import catalog

PROBE = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def listed(folder: str, before: str = "") -> list[int]:
    env = {**os.environ, "PYTHONPATH": folder}
    done = subprocess.run([sys.executable, "-c", before + PROBE], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return [int(x) for x in done.stdout.split()]


@pytest.fixture
def copy(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)

    def made(*without: str) -> str:
        shutil.copytree(os.path.join(ROOT, "belegwerk"), tmp_path / "belegwerk", ignore=shutil.ignore_patterns("__pycache__", *without))
        return str(tmp_path)

    return made


def test_without_the_folder_but_with_the_pipeline(copy):
    assert listed(copy("llm")) == [len(catalog.names()), len(catalog.sql())]


def test_without_folder_and_pipeline(copy, tmp_path):
    folder = copy("llm")
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert listed(folder) == [len(catalog.names()), len(catalog.sql())]


@pytest.mark.parametrize("library", ["tiktoken", "regex", "public_tokenizers"])
def test_without_a_library(copy, library):
    blocked = f"import sys; sys.modules[{library!r}] = None; "
    assert listed(copy(), blocked) == [len(catalog.names()), len(catalog.sql())]
