"""Search specifications, and the registered queries with their SQL."""

from . import catalogue, files, pages, texts, works
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalogue", "files", "pages", "texts", "works"]
