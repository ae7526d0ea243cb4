"""Pixel-level image measurement on Spark: images as DataFrames of pixels, operators as query plans."""
