"""Training-corpus operators on Spark DataFrames."""
