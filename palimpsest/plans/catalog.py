"""Registered queries of the engine and the SQL that checks them."""
from __future__ import annotations

from palimpsest.plans import activity, changes, recall, retrieval

QUERIES: dict = retrieval.QUERIES | activity.QUERIES | recall.QUERIES | changes.QUERIES
ORACLES: dict = retrieval.ORACLES | activity.ORACLES | recall.ORACLES | changes.ORACLES
