"""Corvane: a batch-first ranking and retrieval library on Spark DataFrames."""
