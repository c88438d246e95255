"""Geospatial field data and corpus preparation on Spark DataFrames."""
