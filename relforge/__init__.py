"""Schema discovery and relational normalisation on Spark DataFrames."""
