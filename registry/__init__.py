"""Registered queries over the given tables, each with the SQL that checks it where SQL can."""

from registry.core import ORACLES, QUERIES
from registry import history, packs, paths, selection, streams, symbols, tables, trees  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
