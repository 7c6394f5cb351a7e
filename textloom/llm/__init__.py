"""Training-data operators: fingerprints, filters, decontamination, sharding, tagging, tokens, near-dedup."""
