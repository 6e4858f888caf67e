"""All queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from lodeline.llm import conversations, credentials, mixing, personal, sentences, splitting, tokens

_PARTS = [credentials, personal, splitting, conversations, tokens, mixing, sentences]
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
