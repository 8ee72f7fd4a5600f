"""Raster and measurement analytics as ordinary Spark DataFrame jobs."""
