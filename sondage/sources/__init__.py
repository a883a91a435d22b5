"""Reading, writing, fingerprinting and versioning tables."""
