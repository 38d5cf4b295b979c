"""Queries over the given tables. Importing the modules registers them."""

from . import images, large, reports, search, sqlsurface, stores, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
