"""Document discovery and ranking, and corpus operations, on Spark DataFrames."""
