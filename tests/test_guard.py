"""Nothing outside the optional subpackage imports it, but for the guarded entry."""

import sys
from pathlib import Path

import pytest

import skein

ROOT = Path(__file__).resolve().parents[1]


def test_core_stands_alone():
    for path in (ROOT / "skein").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "skein.llm" not in path.read_text() and "from .llm" not in path.read_text(), path


@pytest.mark.parametrize("gone", ["skein.llm", "skein.llm.queries", "corpus_pipeline"])
def test_entry_without_subpackage(monkeypatch, gone):
    """Also where only something that the subpackage needs is not installed, as its import fails alike."""
    import __spark_entry__
    from skein import catalogue

    for name in [m for m in sys.modules if m == "skein.llm" or m.startswith("skein.llm.") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    if gone.startswith("skein.llm") and hasattr(skein, "llm"):
        monkeypatch.delattr(skein, "llm")
    monkeypatch.setitem(sys.modules, gone, None)
    known, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalogue.QUERIES) <= set(known) and set(catalogue.ORACLES) <= set(oracles) and "pipeline" not in known
    if gone.startswith("skein.llm"):
        assert set(known) == set(catalogue.QUERIES)
