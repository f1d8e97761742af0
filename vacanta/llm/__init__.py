"""Training-data operators: extraction, filtering, deduplication, packing and token output."""
