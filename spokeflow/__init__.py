"""Spokeflow: sensor-run analytics and corpus preparation expressed as Spark DataFrames."""

__version__ = "0.1.0"
