"""Training-data operators: fingerprints, near-dedup, archives, quality, tokens, chat, mixing, secrets."""
