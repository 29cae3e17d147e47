"""Tessera: property-graph analytics on Spark DataFrames."""
