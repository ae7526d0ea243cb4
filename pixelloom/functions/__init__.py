"""Column functions and NumPy helpers."""
