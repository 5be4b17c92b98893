"""Parsing of scholarly documents and matching of their references, on Spark DataFrames."""
