"""Registry of the engine's queries and their SQL counterparts."""

from __future__ import annotations

from .plans import kernel, networks, relational, reports, statistics  # noqa: F401
from .plans.registry import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "molecule_report"
