"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from .base import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
