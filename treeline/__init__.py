"""Treeline: DataFrame operators for file-tree inventories and path-keyed tables on Spark."""

__version__ = "0.1.0"
