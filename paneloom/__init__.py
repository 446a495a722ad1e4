"""Customer features from panel data, written as Spark DataFrame programs."""

from paneloom.spec import PanelSpec

__all__ = ["PanelSpec"]
