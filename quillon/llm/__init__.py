"""Training-data operators: packing, dedup, search, scoring, mixing and fingerprints."""
