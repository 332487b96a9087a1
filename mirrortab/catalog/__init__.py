"""Named queries over the given tables, each with the SQL that another engine can check it by."""

from mirrortab.catalog import clean, compare, generate, profile, runs, tables  # noqa: F401
from mirrortab.catalog.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
