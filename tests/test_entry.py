"""The library and its entry point without the optional training-data part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert "flow_prepare" in names and set(e.oracle_sql()) <= names
print(sorted(n for n in names if n.startswith("op") and n[2].isdigit() or n == "pipeline"))
"""


def run(where: str) -> str:
    env = {**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=where, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.strip().splitlines()[-1]


def copied(to: str, *without: str) -> str:
    keep = shutil.ignore_patterns("__pycache__", *without)
    shutil.copytree(os.path.join(ROOT, "threatspark"), os.path.join(to, "threatspark"), ignore=keep)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), to)
    return to


@pytest.mark.parametrize("without", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_import_without_the_optional_part(scratch, without):
    assert run(copied(scratch, *without)) == "[]"


def test_import_with_an_emptied_folder(scratch):
    os.mkdir(os.path.join(copied(scratch, "llm"), "threatspark", "llm"))
    assert run(scratch) == "[]"


def test_other_import_errors_are_not_hidden(scratch):
    copied(scratch, "llm", "corpus_pipeline.py")
    os.mkdir(os.path.join(scratch, "threatspark", "llm"))
    with open(os.path.join(scratch, "threatspark", "llm", "registry.py"), "w") as f:
        f.write("import no_such_module_anywhere\n")
    with pytest.raises(AssertionError, match="no_such_module_anywhere"):
        run(scratch)
