"""No module defines a function or class twice: the later one would replace the earlier without a word."""

import ast
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
FILES = [p for top in ("tidewell", "tests") for p in sorted((ROOT / top).rglob("*.py")) if "llm" not in p.parts] + [ROOT / "bench.py", ROOT / "__spark_entry__.py"]


@pytest.mark.parametrize("path", FILES, ids=lambda p: str(p.relative_to(ROOT)))
def test_names_are_defined_once(path):
    for scope in [n for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, (ast.Module, ast.ClassDef))]:
        names = Counter(n.name for n in scope.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)))
        assert [n for n, k in names.items() if k > 1] == []
