"""All queries of the core, by name."""

from __future__ import annotations

from ledgerloom.plans import diffs, outputs, pipeline, reads, streams, texts, upkeep

_MODULES = (reads, diffs, texts, upkeep, outputs, streams, pipeline)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
