"""All queries of the engine by name, and the SQL they are held against."""

from __future__ import annotations

from .plans import aggregation, events, extraction, fields, identity, ingest, jobs, markup, matching, ordering, parsers, quality, records, scalars, streams, texts, variants  # noqa: F401  they register themselves
from .plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
