"""Every query of the engine with the SQL that gives the same rows."""

from __future__ import annotations

from workloom.plans import analytics, connectors, etl, lookups, matching, payloads, read_models, reference_data, reports, streams, upkeep, writes

_PACKS = (reports, matching, etl, analytics, read_models, writes, payloads, reference_data, streams, lookups, upkeep, connectors)

QUERIES = {name: run for pack in _PACKS for name, run in pack.QUERIES.items()}
ORACLES = {name: sql for pack in _PACKS for name, sql in pack.ORACLES.items()}
