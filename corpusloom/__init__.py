"""Corpus analytics operators on Spark DataFrames."""
