"""Decision-memory analytics on Spark DataFrames."""
