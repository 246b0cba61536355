"""Document-compliance analytics on Spark DataFrames."""
