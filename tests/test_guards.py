"""Static rules on the library's own source."""

import ast
import re
from pathlib import Path

PACKAGE = Path(__file__).resolve().parent.parent / "kronolit"
FILES = sorted(PACKAGE.rglob("*.py"))


def test_no_forbidden_calls():
    for f in FILES:
        text = f.read_text()
        for word in ("localCheckpoint(", ".rdd", "crossJoin(", "pip install", ".toPandas("):
            assert word not in text, (f, word)


def test_llm_is_an_island():
    for f in FILES:
        if "llm" in f.relative_to(PACKAGE).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), f


def test_queries_read_whole_tables():
    for f in PACKAGE.rglob("*.py"):
        if f.name in ("queries.py", "register.py", "preparation.py", "market.py") and "plans" in f.parts or f.name == "queries.py":
            assert not re.search(r"\.limit\(|\.sample\(|% 100|\.take\(", f.read_text()), f


def test_broadcasts_are_bounded():
    """Every broadcast stands with the reason why its size is bounded, here listed by file."""
    known = {"units.py", "returns.py", "canonical.py", "tokens.py", "packing.py"}
    assert {f.name for f in FILES if "broadcast(" in f.read_text()} <= known
