"""Images, labels and positions as DataFrames."""
