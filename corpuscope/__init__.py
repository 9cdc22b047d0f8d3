"""Retrieval, evaluation and usage analytics over large document collections, on Spark DataFrames."""
