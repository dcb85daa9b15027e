"""Training-data operators: sharding, mixing, deduplication, scoring, tokenising."""
