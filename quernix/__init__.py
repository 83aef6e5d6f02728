"""A typed, serializable analytics pipeline engine that compiles to lazy Spark DataFrames."""

__version__ = "0.1.0"
