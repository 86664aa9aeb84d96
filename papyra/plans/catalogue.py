"""Every module of queries is imported here, once, so that the registry is whole."""

from __future__ import annotations

from . import document_queries, io_queries, library_queries, more_queries, record_queries, solver_queries, source_queries, text_queries, tool_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
