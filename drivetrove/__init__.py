"""Analytics over catalogues of large, mostly offline storage, on Spark DataFrames."""

from drivetrove.catalog import Catalog
from drivetrove.schema import TABLES, conform

__all__ = ["Catalog", "TABLES", "conform"]
