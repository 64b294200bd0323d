"""Source-anchored claim analytics on Spark DataFrames."""
