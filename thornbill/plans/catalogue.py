"""All core queries and their SQL."""

from __future__ import annotations

from thornbill.plans import report_queries, retrieval_queries, text_queries

_MODULES = (text_queries, retrieval_queries, report_queries)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
