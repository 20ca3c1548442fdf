"""loomspan: layout-style analytics and training-data operators on Spark DataFrames."""
