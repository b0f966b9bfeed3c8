"""The queries over the engine's own operators, by name, and the SQL they are checked against."""

from __future__ import annotations

from lodestone.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
