"""Retrieval, support analytics and training-data operators on Spark DataFrames."""
