"""Measurements on images that arrive over time."""
