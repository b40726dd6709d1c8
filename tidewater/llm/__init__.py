"""Training-data operators: fingerprints, WARC derivatives, PII, mixing, dedup, BPE, ANN, toxicity."""
