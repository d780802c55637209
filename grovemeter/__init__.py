"""Storage-usage and accounting analytics on Spark DataFrames."""
