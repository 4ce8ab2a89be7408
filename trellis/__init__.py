"""A mesh analytics engine on Spark DataFrames."""
