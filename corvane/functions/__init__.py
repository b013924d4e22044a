"""Column functions: text measures, routing signals, hashing."""
