"""Brisa: plant-level renewable generation analytics on Spark DataFrames."""

__version__ = "0.1.0"
