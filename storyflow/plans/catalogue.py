"""All core queries and their oracles, by name."""

from __future__ import annotations

from . import delivery, events, graphs, maintenance, read_models, relations, rollups, selections, streams, text_rules, vectors

_MODULES = (events, read_models, text_rules, relations, vectors, maintenance, rollups, graphs, streams, delivery, selections)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: q for m in _MODULES for name, q in getattr(m, "ORACLE", {}).items()}
