"""Measurements on pixels, written as DataFrame plans."""
