"""Spatial cell-count analytics on Spark: every operator is DataFrame -> DataFrame."""
