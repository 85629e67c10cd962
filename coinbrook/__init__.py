"""Personal-finance analytics and training-data operators on Spark DataFrames."""
