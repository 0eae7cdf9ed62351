"""Analytics of news integrity on Spark DataFrames."""
