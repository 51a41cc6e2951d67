"""The entry works where the optional package and the pipeline are absent."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert "hybrid_topk" in names and "pipeline" not in names and not any(n.startswith("op") for n in names), names
assert set(e.oracle_sql()) <= names
"""


def test_without_the_optional_package(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})


def test_where_what_the_optional_package_imports_is_absent(tmp_path):
    (tmp_path / "tokenizers.py").write_text("raise ImportError('not on this machine')")
    env = os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"}
    subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, check=True, env=env)


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "lexivec")):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "lexivec.llm" not in f.read(), name
