"""The registered queries over the corpus tables and the SQL they are checked against."""

from __future__ import annotations

from docquarry.operators import analyses, changes, closeness, detection, filters, fulltext, keyness, keywords, library, places, reports, results, search, signals, statistics, totals  # noqa: F401
from docquarry.sources import fingerprint  # noqa: F401
from docquarry.streaming import monitoring, outcomes, rules  # noqa: F401
from docquarry.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
