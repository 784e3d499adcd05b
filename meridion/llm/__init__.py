"""Training-data operators: scoring, mixing, rules, search, deduplication, filters, sharding, packing, token counts."""
