"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from thornbill.llm import dedup, leakage, lookalike, pairs, pieces, sentences, spans, tokens

_MODULES = (sentences, pieces, pairs, dedup, lookalike, tokens, leakage, spans)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
