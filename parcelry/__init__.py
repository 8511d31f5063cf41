"""Spatial risk analytics on Spark: tilings, splits, neighbour graphs, smoothing, inspection campaigns and their costs."""
