"""Batch and streaming text embedding, late chunking and ranking on Spark DataFrames."""
