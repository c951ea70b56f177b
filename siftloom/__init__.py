"""Set-at-a-time collection, document and catalog analytics on Spark DataFrames."""

__version__ = "0.1.0"
