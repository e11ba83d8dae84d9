"""nightloom: epoch analytics on Spark DataFrames."""
