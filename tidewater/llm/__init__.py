"""Training-data operators: ten large-scale corpus operations built on Spark DataFrames."""
