"""The entry module without the training-data operators, or without a package that they need."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT
from viewlens.plans.registry import all_queries

COUNT = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()), 'transactions' in E.queries())"


def run(code, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_without_a_package_of_the_operators():
    n = str(len(all_queries()))
    assert run("import sys; sys.modules['public_tokenizers'] = None; " + COUNT, ROOT) == [n, n, "True"]


def test_with_an_empty_folder_or_none(tmp_path):
    for part in ("viewlens", "oracle"):
        shutil.copytree(os.path.join(ROOT, part), tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    n = str(len(all_queries()))
    assert run(COUNT, tmp_path) == [n, n, "True"]
    (tmp_path / "viewlens" / "llm").mkdir()
    assert run(COUNT, tmp_path) == [n, n, "True"]
