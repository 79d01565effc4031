"""Registry of the engine's queries: name to Spark function, and the oracle SQL of most."""

from __future__ import annotations

from .plans import common, lives, processing, records, reports, reviews, scans, scores

MODULES = (scans, reports, scores, processing, reviews, lives, records)


def queries() -> dict:
    return dict(common.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(common.SQL)
