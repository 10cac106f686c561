"""The entry point works without the corpus operators, whether the pipeline file is left or not."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]


@pytest.mark.parametrize("gone", [["weir/llm"], ["weir/llm", "corpus_pipeline.py"]])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "weir", tmp_path / "weir", ignore=shutil.ignore_patterns("__pycache__"))
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path, ignore_errors=True)
        path.unlink(missing_ok=True)
    check = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'a2_bm25f' in q and set(o) <= set(q) and 'pipeline' not in q and not any(k.startswith('op') for k in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", check], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 150


def test_other_import_errors_are_not_hidden(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path / "__spark_entry__.py")
    shutil.copytree(ROOT / "weir", tmp_path / "weir", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    (tmp_path / "weir/llm").mkdir()
    (tmp_path / "weir/llm/__init__.py").write_text("")
    (tmp_path / "weir/llm/queries.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "no_such_module" in done.stderr
