"""Rillet: message-stream analytics expressed as Spark DataFrames."""
