"""Batch retrieval and relevance analytics on Spark DataFrames."""
