"""Training-data operators: packing, search, mixing, fingerprints, personal data, sharding,
URL filtering, near-duplicates and toxicity.  Nothing outside this package imports it."""
