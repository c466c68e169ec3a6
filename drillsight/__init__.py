"""Drillsight: engagement analytics for security-awareness drills, on Spark DataFrames."""

__version__ = "0.1.0"
