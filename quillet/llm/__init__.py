"""Training-data operators: ten large-scale corpus jobs written on Spark DataFrames."""
