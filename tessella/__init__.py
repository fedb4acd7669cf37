"""Tessella: governed semantic queries, hybrid retrieval and corpus tools on Spark DataFrames."""
