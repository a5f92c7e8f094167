"""Motif analytics on Spark DataFrames."""
