"""Training-data operators: mixing, near-duplicates, tokenising, filtering and extraction as Spark jobs."""
