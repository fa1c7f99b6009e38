"""All queries of the library by name, and their oracles."""

from __future__ import annotations

from tessera.plans import files, generated, layouts, orders, products, profiles  # noqa: F401 (they register their queries)
from tessera.plans.fixtures import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
