"""The entry module, with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def ask(folder):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=folder, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_loads_without_the_optional_parts(tmp_path, with_pipeline):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if with_pipeline else ["corpus_pipeline.py"])))
    n, numbered, pipeline = ask(tmp_path / "repo")
    assert int(n) > 60 and numbered == "0" and pipeline == "False"


@pytest.mark.parametrize("broken", ["__init__", "queries", "pieces"])
def test_entry_loads_where_an_import_of_llm_fails(tmp_path, broken):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    os.makedirs(tmp_path / "repo" / "braidwork" / "llm", exist_ok=True)
    with open(tmp_path / "repo" / "braidwork" / "llm" / f"{broken}.py", "w") as f:
        f.write("import a_library_that_is_missing\n")
    n, numbered, pipeline = ask(tmp_path / "repo")
    assert int(n) > 60 and numbered == "0" and pipeline == "False"


def test_entry_gives_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["family", "i", "j", "n_ali", "si", "tm", "rmsd"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
