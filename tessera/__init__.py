"""Tessera: text-corpus curation on Spark DataFrames."""
