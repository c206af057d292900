"""Raster frames, image pyramids and large text corpora as Spark DataFrames."""
