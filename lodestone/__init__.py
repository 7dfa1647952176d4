"""Document-corpus processing and hybrid retrieval on Spark DataFrames."""
