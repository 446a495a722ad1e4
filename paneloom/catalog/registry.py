"""All named queries."""

from __future__ import annotations

from paneloom.catalog import files, labelled, models, panel, profiling, statistics

CATALOG = {
    **panel.QUERIES,
    **labelled.QUERIES,
    **profiling.QUERIES,
    **statistics.QUERIES,
    **models.QUERIES,
    **files.QUERIES,
}
