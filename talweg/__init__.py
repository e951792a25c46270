"""talweg: a PySpark-native engine for gridded terrain and flow-graph analytics."""

from talweg.grid import FlowDirection, GridMeta

__all__ = ["FlowDirection", "GridMeta"]
__version__ = "0.1.0"
