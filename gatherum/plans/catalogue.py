"""All registered queries of the core engine and their SQL."""

from __future__ import annotations

from gatherum.plans import q_checks, q_documents, q_measures, q_profile, q_readers, q_records, q_rules, q_text  # noqa: F401
from gatherum.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
