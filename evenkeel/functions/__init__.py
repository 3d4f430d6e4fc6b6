"""Column functions: hashes, candidate workers, Zipf numbers."""
