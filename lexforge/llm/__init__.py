"""Training-data operators: deduplication, mixing, filtering, search, encoding, media and scoring."""
