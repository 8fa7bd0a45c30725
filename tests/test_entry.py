"""The entry file with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(*sorted(set(e.queries()) - set(e.oracle_sql())), '|', *e.queries())"


def _copy(target, left_out):
    skip = {str(ROOT / p) for p in (*left_out, ".git")}
    shutil.copytree(ROOT, target, ignore=lambda folder, names: [n for n in names if f"{folder}/{n}" in skip or n in ("__pycache__", "spark-warehouse")])
    return target


def _queries(folder):
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    bare, names = done.stdout.split("|")
    return bare.split(), names.split()


@pytest.mark.parametrize("left_out", [("sheaf/llm", "tests/llm"), ("sheaf/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_subpackage(tmp_path, left_out):
    from registry import ORACLES, QUERIES

    folder = _copy(tmp_path / "copy", left_out)
    bare, names = _queries(folder)
    assert set(names) == set(QUERIES) and set(bare) == set(QUERIES) - set(ORACLES)
    # an empty folder left behind counts as missing
    (folder / "sheaf/llm/__pycache__").mkdir(parents=True)
    assert _queries(folder)[1] == names


def test_the_rest_does_not_import_it():
    for folder in ("sheaf", "registry"):
        for file in (ROOT / folder).rglob("*.py"):
            if "llm" not in file.parts:
                assert "sheaf.llm" not in file.read_text(), file


@pytest.mark.skipif(not (ROOT / "sheaf/llm/__init__.py").exists(), reason="needs the subpackage")
def test_with_it():
    _, names = _queries(ROOT)
    assert "pipeline" in names and "op1_substring_dedup" in names
