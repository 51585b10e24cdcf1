"""Training-data operators: search, near-duplicates, filters, tokens, packing."""
