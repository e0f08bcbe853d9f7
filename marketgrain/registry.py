"""All queries of the analytics operators, and their SQL."""

from __future__ import annotations

from marketgrain import queries_documents, queries_more, queries_rules, queries_streams  # noqa: F401
from marketgrain.queries import ORACLE_SQL, QUERIES  # noqa: F401
