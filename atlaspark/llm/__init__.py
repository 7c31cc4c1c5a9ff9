"""Training-data operators: packing, search, sharding, clean-up and deduplication on Spark."""
