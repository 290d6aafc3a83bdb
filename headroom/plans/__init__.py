"""Operators as named relations, in the order of their definition."""

from . import relations, tables, pricing, windows, estimate, report, ingest  # noqa: F401, I001
