"""Training-data operators: deduplication, search, quality, packing, formatting and output."""
