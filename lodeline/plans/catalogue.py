"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from lodeline.operators import collect, correlate, hybrid, lexical, nodes, retrieval, sessions, store, structure, timestamps, upkeep, vectors
from lodeline.plans import sources
from lodeline.sources import files
from lodeline.streaming import ingest

_PARTS = [sessions, timestamps, lexical, vectors, retrieval, hybrid, store, upkeep, correlate, collect, nodes, structure, ingest, sources, files]
FLAGSHIP = "q17_context"
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
