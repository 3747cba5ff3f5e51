"""The rest of the library neither imports nor needs this subpackage."""

import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[2]


def test_nothing_else_imports_llm():
    for path in (ROOT / "opsloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "opsloom.llm" not in path.read_text()


def test_entry_without_llm(tmp_path):
    import shutil

    shutil.copytree(ROOT / "opsloom", tmp_path / "opsloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a7_metrics_by_task' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
