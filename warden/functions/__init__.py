"""Column functions: text, addresses, tokens, fingerprints."""
