"""Citeloom: DataFrame operators that measure how far a reference can be trusted.

Every operator takes and returns Spark DataFrames. Nothing here collects a growing table.
"""

__version__ = "0.1.0"
