"""All queries that the engine registers, and the SQL of each."""

from __future__ import annotations

from cellbasis.plans import oracle, oracle_io, queries, queries_io  # noqa: F401 - queries_io registers its queries on import

QUERIES = queries.QUERIES
SQL: dict[str, str] = {**oracle.SQL, **oracle_io.SQL}
