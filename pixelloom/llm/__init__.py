"""Training-data operators: dedup, tokens, packing, filters and scoring over document tables."""
