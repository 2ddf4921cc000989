"""Training-data operators: tokens, deduplication, mixing, quality, search, sharding and audits."""
