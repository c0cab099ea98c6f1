"""Column functions: text, licenses, hashes, vectors, pixels."""
