"""wardwise: ensemble analysis of districting plans on Spark DataFrames."""

__version__ = "0.1.0"
