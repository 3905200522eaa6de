"""Event-stream analytics on Spark DataFrames."""
