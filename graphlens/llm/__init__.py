"""Training-data operators: packing, fingerprints, dedup, scans, tokens and classifiers."""
