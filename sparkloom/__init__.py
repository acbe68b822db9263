"""Sparkloom: a strict relational layer, layouts, statistics and corpus operators on PySpark DataFrames."""

__version__ = "0.1.0"
