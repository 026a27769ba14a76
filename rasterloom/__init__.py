"""Raster analytics on Spark: zonal statistics, alignment, clipping and a config-driven raster catalog over pixel DataFrames."""

__version__ = "0.1.0"
