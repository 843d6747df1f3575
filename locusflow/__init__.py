"""Genomic-interval analytics on Spark DataFrames."""
