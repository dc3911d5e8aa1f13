"""The library without the operators for training data."""

from __future__ import annotations

import ast
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_operators(tmp_path, pipeline):
    for name in ("presswork", "workload", "__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    code = ("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); "
            "assert set(s) <= set(q) and len(q) > 70 and not any(n.startswith('op') and n[2].isdigit() for n in q), sorted(q)")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr[-2000:]


def test_nothing_else_imports_them():
    for path in [*(REPO / "presswork").rglob("*.py"), *(REPO / "workload").rglob("*.py")]:
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(
                node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
