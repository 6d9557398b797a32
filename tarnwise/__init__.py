"""Daily price-panel research on Spark DataFrames."""
