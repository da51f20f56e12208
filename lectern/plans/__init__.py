"""Registered queries over the shared tables, with their SQL equivalents."""

from lectern.plans import accepted, aggregates, audits, choices, copied, documents, joins, lifecycle, predicates, ranking, records, sampling, texts
from lectern.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "audits", "documents", "joins", "lifecycle", "predicates", "ranking", "records", "sampling", "texts"]
