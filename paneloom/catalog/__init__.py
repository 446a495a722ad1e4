"""Named queries over the sample tables, each with the SQL that checks it."""

from paneloom.catalog.registry import CATALOG

__all__ = ["CATALOG"]
