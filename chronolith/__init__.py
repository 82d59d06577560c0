"""Time-series archive analytics on Spark DataFrames."""
