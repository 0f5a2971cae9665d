"""Bus-traffic analytics on Spark DataFrames."""
