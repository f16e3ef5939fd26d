"""All registered queries, by survey section."""

from . import base
from .base import ORACLE, QUERIES
from . import ingest, scoring, robust, spreads, closing, fitted  # noqa: F401

__all__ = ["ORACLE", "QUERIES", "base"]
