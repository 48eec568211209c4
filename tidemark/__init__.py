"""Ranking analytics and decision science on Spark DataFrames."""

__version__ = "0.1.0"
