"""Model-routing analytics on Spark DataFrames."""
