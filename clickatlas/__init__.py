"""Site-graph analytics on Spark DataFrames."""
