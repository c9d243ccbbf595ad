"""Column-level functions: text, time, vectors, hashing."""
