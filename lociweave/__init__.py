"""Synteny-aware ortholog analytics on Spark DataFrames."""
