"""Typed component tables, live queries and batch operators on Spark DataFrames."""
