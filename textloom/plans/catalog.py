"""All registered queries of the library's own operators."""

from __future__ import annotations

from textloom.plans import annotation, corpus, exports, pages, quality, relational, reports, streams, text, warehouse  # noqa: F401
from textloom.plans.registry import ORACLES, QUERIES

FLAGSHIP = "corpus_summary_by_lang"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
