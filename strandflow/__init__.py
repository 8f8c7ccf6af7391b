"""Filament curves, rasters and per-curve measurements as Spark DataFrames."""

__version__ = "0.1.0"
