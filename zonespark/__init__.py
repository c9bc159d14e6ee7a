"""zonespark: flow-based regionalization and large-table data processing as PySpark programs."""

__version__ = "0.1.0"
