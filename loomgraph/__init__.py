"""Sequence-assembly and k-mer analytics on Spark DataFrames."""
