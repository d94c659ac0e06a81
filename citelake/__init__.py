"""Citation-audit analytics on Spark DataFrames."""
