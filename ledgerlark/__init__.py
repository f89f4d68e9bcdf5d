"""Batch analytics over transfer records, and corpus operators, on Spark DataFrames."""
