"""Training-data operators: deduplication, scoring, sharding, packing and export."""
