"""A bitemporal fact engine on Spark DataFrames."""
