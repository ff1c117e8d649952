"""Every registered query of the core library, with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from skein.plans import corpus, digests, graphs, records, search, texts  # noqa: F401
from skein.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
