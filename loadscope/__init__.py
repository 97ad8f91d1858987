"""Load-surface analytics on Spark DataFrames."""
