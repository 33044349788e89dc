"""The entry point with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LEFT_OUT = shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache")
CODE = """
import __spark_entry__ as E
from rankloom.plans import oracle, registry
import tools.oracle_check
assert set(E.queries()) == set(registry.QUERIES), set(E.queries()) ^ set(registry.QUERIES)
assert set(E.oracle_sql()) == set(oracle.SQL) & set(registry.QUERIES)
"""


def run(folder, code):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)


def test_without_the_subpackage_only_the_core_queries_are_registered(tmp_path):
    shutil.copytree(ROOT, tmp_path / "with_pipeline", ignore=LEFT_OUT)
    found = run(tmp_path / "with_pipeline", CODE)
    assert found.returncode == 0, found.stderr
    shutil.copytree(ROOT, tmp_path / "without", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    found = run(tmp_path / "without", CODE)
    assert found.returncode == 0, found.stderr


def test_an_import_that_fails_inside_the_subpackage_is_not_hidden(tmp_path):
    if not os.path.isdir(os.path.join(ROOT, "rankloom", "llm")):
        return
    shutil.copytree(ROOT, tmp_path / "broken", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (tmp_path / "broken" / "rankloom" / "llm" / "queries.py").write_text("import no_such_module")
    assert "no_such_module" in run(tmp_path / "broken", "import __spark_entry__").stderr
