"""The entry module imports without a session, and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(where: Path) -> list[str]:
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=where, env={"PYTHONPATH": str(where), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split()


def test_imports_with_and_without_llm(tmp_path):
    shutil.copytree(ROOT / "attestry", tmp_path / "attestry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    rest = names(tmp_path)
    assert len(rest) > 100 and not any(n.startswith("op1") or n == "pipeline" for n in rest)
    assert set(rest) <= set(names(ROOT))
