"""Readers of tables, journals and text collections."""

from tessella.sources.tables import table

__all__ = ["table"]
