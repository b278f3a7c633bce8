"""Training-data operators: deduplication, filtering, mixing, encoding and search over large text tables."""
