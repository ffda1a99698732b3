"""Document question answering and training-data analytics on Spark DataFrames."""
