"""Training-data operators: sharding, deduplication, classifiers, packing and media columns."""
