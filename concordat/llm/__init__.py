"""Training-data operators: search, tokenising, filtering, deduplication and packing at corpus scale."""
