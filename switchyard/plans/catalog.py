"""The full query catalogue: importing this module registers every key."""

from __future__ import annotations

from . import catalog_changes, catalog_checks, catalog_io, catalog_relational, catalog_streams  # noqa: F401
from .registry import ORACLES, QUERIES, SECTIONS

__all__ = ["ORACLES", "QUERIES", "SECTIONS"]
