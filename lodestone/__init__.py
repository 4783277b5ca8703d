"""Lodestone: lexical retrieval, ranking, recommendation and search analytics on Spark DataFrames."""
