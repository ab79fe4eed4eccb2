"""All registered queries of the engine and their SQL."""

from . import ingestion, ingestion_oracles, oracles, queries

QUERIES = queries.QUERIES | ingestion.QUERIES
ORACLES = oracles.ORACLES | ingestion_oracles.ORACLES
