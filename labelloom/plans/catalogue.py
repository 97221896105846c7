"""All named queries of the core, and their SQL twins."""

from labelloom.plans import queries, scalar_queries, store_queries  # noqa: F401

QUERIES, ORACLE = queries.QUERIES, queries.ORACLE
