"""Concordat: a register of contract terms, maintained with Spark.

Every operator takes DataFrames and returns DataFrames.  See README.md.
"""
