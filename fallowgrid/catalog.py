"""Every registered query with its DuckDB counterpart."""

from __future__ import annotations

from .plans import analytics, features, reporting, spatial, suitability

_ALL = suitability.QUERIES | analytics.QUERIES | features.QUERIES | reporting.QUERIES | spatial.QUERIES
QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLE = {name: sql for name, (_, sql) in _ALL.items() if sql}
